"""Closeness by every method against a search from every vertex, and the three normalizations."""

from __future__ import annotations

import pytest

from farness.graph import Graph
from farness.operators.traverse import bfs_pairs, least_sums, msbfs_sums
from farness.plans import closeness
from farness.scratch import Scratch
from farness.sources import generate
from tests.graphs import DISCO, WHEEL, frame, random_edges, sums


def rows(df):
    return {r.id: (r.r, r.d) for r in df.collect()}


def test_golden_values(spark):
    got = {r.id: r.closeness for r in closeness(frame(spark, *DISCO), "bits", "wf").collect()}
    assert [round(got[i], 6) for i in range(7)] == [0.222222, 0.333333, 0.222222, 0.5, 0.3, 0.3, 0.3]
    classic = {r.id: r.closeness for r in closeness(frame(spark, *DISCO), "bits", "classic").collect()}
    assert [classic[i] for i in range(7)] == [2.0, 3.0, 2.0, 2.0, 1.2, 1.2, 1.2]
    reach = {r.id: round(r.closeness, 6) for r in closeness(frame(spark, *DISCO), "pairs", "reachable").collect()}
    assert [reach[i] for i in range(7)] == [0.666667, 1.0, 0.666667, 1.0, 0.6, 0.6, 0.6]


@pytest.mark.parametrize("method", ["pairs", "bits", "reduced", "blocks"])
def test_methods_equal_search(spark, method):
    edges = random_edges(7, 30, 34) + [(3, 3), (1, 2), (2, 1), (1, 2)]
    assert rows(closeness(frame(spark, 33, edges), method)) == sums(33, edges)


def test_more_sources_than_bits(spark):
    edges = [(i, i + 1) for i in range(0, 129, 1) if i % 9] + [(i, (i * 7) % 130) for i in range(0, 130, 9)] + [(0, i) for i in range(1, 130, 5)]
    assert rows(closeness(frame(spark, 130, edges), "bits")) == sums(130, edges)


def test_redundant_vertices_far_apart_are_exact(spark):
    second = [(u + 10, v + 10) for u, v in WHEEL]
    path = [(1, 20), (20, 21), (21, 22), (22, 11)]
    for edges in (WHEEL + second + path, WHEEL + second):
        assert rows(closeness(frame(spark, 23, edges), "reduced", "classic")) == sums(23, edges)


def test_no_edges_and_one_vertex(spark):
    for n in (0, 1, 3):
        got = closeness(frame(spark, n, []), "bits").collect()
        assert [(r.r, r.d, r.closeness) for r in got] == [(0, 0, 0.0)] * n


@pytest.mark.parametrize("method", ["weighted", "confined"])
def test_directed_graphs_equal_search(spark, method):
    diamond = [(0, 1, 1), (0, 2, 1), (1, 3, 1), (2, 3, 1)]
    bridges = [(0, 1, 10), (1, 0, 10), (2, 3, 10), (3, 2, 10), (0, 2, 1), (1, 3, 1)]
    chain = [(0, 1, 2), (1, 0, 3), (1, 2, 4), (2, 3, 1), (3, 2, 1), (0, 4, 5), (4, 5, 1), (5, 4, 2)]
    for n, edges in ((4, diamond), (4, bridges), (7, chain)):
        assert rows(closeness(frame(spark, n, edges, True), method)) == sums(n, edges, True)


def test_bits_go_out_of_directed_vertices(spark):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (4, 3)]
    assert rows(closeness(frame(spark, 5, edges, True), "bits")) == sums(5, edges, True)


@pytest.mark.parametrize("directed", [False, True])
def test_tables_and_tasks_sum_alike(spark, directed):
    graph = generate.uniform(spark, 150, 170, 5)
    edges = graph.edges if not directed else graph.edges.unionByName(generate.uniform(spark, 150, 60, 6).edges.selectExpr("dst AS src", "src AS dst"))
    scratch = Scratch(spark, "test")
    arcs = scratch.cut(Graph(graph.vertices, edges, directed).canonical().arcs())
    rows = [sorted(map(tuple, msbfs_sums(arcs, graph.vertices, Scratch(spark, "test"), not directed, most).collect())) for most in (0, 1 << 40)]
    pairs = {i: (0, 0) for i in range(150)}
    for r in bfs_pairs(arcs, graph.vertices, scratch, not directed).collect():
        pairs[r.v] = (pairs[r.v][0] + (r.source != r.v), pairs[r.v][1] + r.d)
    assert rows[0] == rows[1] == sorted((i, *x) for i, x in pairs.items())


@pytest.mark.parametrize("kind", ["long", "double"])
def test_weighted_tables_and_tasks_sum_alike(spark, kind):
    graph = generate.random_directed(spark, 60, 0.03, 9)
    arcs = Scratch(spark, "test").cut(graph.edges.selectExpr("src", "dst", f"CAST(2 * weight AS {kind}) AS weight"))
    rows = [sorted(map(tuple, least_sums(arcs, graph.vertices, Scratch(spark, "test"), most).collect())) for most in (0, 1 << 40)]
    assert rows[0] == rows[1] and dict(least_sums(arcs, graph.vertices, Scratch(spark, "test")).dtypes)["d"] == ("bigint" if kind == "long" else "double")


def test_a_wide_word_of_sources_and_long_paths(spark):
    n = 700
    graph = Graph(spark.range(n), spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst"))
    got = {r.id: (r.r, r.d) for r in msbfs_sums(Scratch(spark, "test").cut(graph.arcs()), graph.vertices, Scratch(spark, "test"), True).collect()}
    assert got == {i: (n - 1, i * (i + 1) // 2 + (n - 1 - i) * (n - i) // 2) for i in range(n)}
