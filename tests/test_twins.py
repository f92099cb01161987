"""Graphs folded by their twins: every method, tables and tasks, against a search; few pairs against whole columns."""

from __future__ import annotations

import numpy as np
import pytest

from farness.graph import Graph
from farness.operators import blocks, local, strong
from farness.operators.redundant import reduced_sums
from farness.operators.traverse import least_sums, msbfs_sums
from farness.operators.twins import folded
from farness.plans import closeness
from farness.scratch import Scratch
from tests.graphs import frame, random_edges, sums

#: Leaves, customers of two hubs, triangles' tips, isolated vertices, and a component apart.
MANY = random_edges(3, 12, 16) + [(0, v) for v in range(20, 90)] + [e for v in range(90, 150) for e in ((1, v), (2, v))] + [(1, 2)] + [(160, v) for v in range(161, 166)] + [e for v in range(170, 175) for e in ((v, 0), (v, 1), (v, 3))] + [(0, 1), (1, 3), (0, 3)]
#: Stars with ways back, by three weights, and bridges out of one of their tips.
WAYS = [e for v in range(10, 60) for e in ((0, v, 1 + v % 3), (v, 0, 1))] + [(59, v, 4) for v in range(60, 80)] + [(70, 80, 2), (80, 70, 9)] + [(1, 0, 2)]


def rows(df):
    return {r.id: (r.r, r.d) for r in df.collect()}


def small(spark, graph):
    scratch, plain = Scratch(spark, "test"), graph.canonical()
    return folded(Graph(scratch.cut(plain.vertices), scratch.cut(plain.edges), plain.directed), scratch), scratch


@pytest.mark.parametrize("method", ["pairs", "bits", "reduced", "blocks"])
def test_twins_of_undirected_graphs(spark, method):
    graph = frame(spark, 180, MANY)
    few, _ = small(spark, graph)
    assert few.graph.vertices.count() < 60
    assert rows(closeness(graph, method)) == sums(180, MANY)


@pytest.mark.parametrize("method", ["weighted", "confined"])
def test_twins_of_directed_graphs(spark, method):
    graph = frame(spark, 82, WAYS, True)
    few, _ = small(spark, graph)
    assert few.graph.vertices.count() < 40
    assert rows(closeness(graph, method)) == sums(82, WAYS, True)


def test_masses_in_rounds_of_tables(spark, monkeypatch):
    few, scratch = small(spark, frame(spark, 180, MANY))
    want, arcs = sums(180, MANY), scratch.cut(few.graph.arcs())
    assert rows(few.unfolded(msbfs_sums(arcs, few.graph.vertices, scratch, True, 0, few.mass), scratch)) == want
    assert rows(few.unfolded(reduced_sums(few.graph, scratch, few.mass), scratch)).items() <= want.items()
    monkeypatch.setattr(blocks._messages, "__defaults__", (0,))
    assert rows(few.unfolded(blocks.block_sums(few.graph, scratch, mass=few.mass), scratch)).items() <= want.items()
    few, scratch = small(spark, frame(spark, 82, WAYS, True))
    want = sums(82, WAYS, True)
    assert rows(few.unfolded(least_sums(few.graph.edges, few.graph.vertices, scratch, 0, few.mass), scratch)) == want
    assert rows(few.unfolded(strong.confined_sums(few.graph, scratch, 0, few.mass), scratch)) == want


def test_equal_hashes_are_not_taken_for_twins(spark, monkeypatch):
    monkeypatch.setattr("farness.operators.twins.F.xxhash64", lambda *x: x[0].cast("long"))
    edges = [(0, 1), (2, 3), (4, 5), (6, 7), (7, 8), (8, 6)]
    few, _ = small(spark, frame(spark, 9, edges))
    assert few.graph.vertices.count() == 9


def test_few_pairs_and_whole_columns_are_the_same():
    rng = np.random.default_rng(4)
    n, m = 600, 1500
    src, dst, weight = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 9, m)
    by_end, by_start = np.lexsort((src, dst)), np.lexsort((dst, src))
    offsets = lambda ends: np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))])
    graph = local.Adjacency(np.array([0, n]), offsets(dst), src[by_end], offsets(src), dst[by_start], weight[by_end], weight[by_start])
    own, mass = np.sort(rng.choice(n, 90, replace=False)), rng.integers(1, 50, n)
    want = local.relaxed(graph, 0, n, own, mass)
    for got in (local.relaxed_pairs(graph, 0, n, own, mass, 1 << 40), local.sums_of(graph, 0, n, own, mass)):
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    assert local.relaxed_pairs(graph, 0, n, own, mass, 100) is None
