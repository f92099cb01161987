"""Components, blocks, strong components and redundant vertices against brute force."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from farness.graph import Graph
from farness.operators import biconnected as bi
from farness.operators.checks import degrees, edges_present, graph_report, max_abs_error, method_mse, run_stats, speedups, top_k
from farness.operators.components import connected_components
from farness.operators.redundant import redundant_vertices
from farness.operators.strong import condensation, strong_components, topological_levels
from farness.scratch import Scratch
from farness.sources import generate
from tests.graphs import WHEEL, components_without, frame, random_edges


@pytest.mark.parametrize("local_edges", [1000, -1])
def test_components(spark, local_edges):
    edges = random_edges(3, 40, 25)
    got = {r.id: r.component for r in connected_components(frame(spark, 40, edges).edges, local_edges=local_edges).collect()}
    want = components_without(40, edges)
    assert all(got.get(v, v) == want[v] for v in range(40))
    path = [(i, i + 1) for i in range(60)]
    assert {r.component for r in connected_components(frame(spark, 61, path).edges, local_edges=local_edges).collect()} == {0}
    assert connected_components(spark.createDataFrame([], "src long, dst long"), local_edges=local_edges).count() == 0


@pytest.mark.parametrize("local_edges", [1000, 0])
def test_blocks(spark, local_edges):
    edges = random_edges(11, 24, 28) + [(20, 21), (21, 22), (22, 20), (22, 23)]
    scratch = Scratch(spark, "test")
    g = frame(spark, 24, edges).canonical()
    blocks = bi.edge_blocks(Graph(scratch.cut(g.vertices), scratch.cut(g.edges)), scratch, local_edges)
    plain = {(min(e), max(e)) for e in edges if e[0] != e[1]}
    got = blocks.collect()
    assert {(r.a, r.b) for r in got} == plain and len(got) == len(plain)
    base = len(set(components_without(24, plain).values()))
    cut = {v for v in range(24) if any(v in e for e in plain) and len(set(components_without(24, plain, v).values())) > base}
    members = bi.block_members(blocks)
    assert {r.v for r in bi.articulation_points(members).collect()} == cut
    by = {}
    for r in got:
        by.setdefault((r.block_a, r.block_b), []).append((r.a, r.b))
    for label, own in by.items():
        assert min(own) == label
        ends = {x for e in own for x in e}
        for gone in ends if len(own) > 1 else []:
            left = components_without(24, own, gone)
            assert len({left[x] for x in ends if x != gone}) == 1


def _by_tables_and_by_search(spark, edges, **how):
    """Blocks by tables and by one search, and how many tables were written."""
    plain = sorted({(min(e), max(e)) for e in edges if e[0] != e[1]})
    scratch = Scratch(spark, "test")
    graph = Graph.of_edges(scratch.cut(spark.createDataFrame(plain, "src long, dst long")))
    got = sorted(tuple(r) for r in bi.edge_blocks(graph, scratch, 0, **how).collect())
    return got, sorted(bi._local_blocks(pd.DataFrame(plain, columns=["a", "b"])).itertuples(index=False, name=None)), scratch.n


def test_blocks_of_deep_rings_take_few_tables(spark):
    ring = [(i, (i + 1) % 300) for i in range(300)] + [(17, 400), (400, 401)]
    got, want, tables = _by_tables_and_by_search(spark, ring)
    assert got == want and tables < 60


@pytest.mark.parametrize("local_arcs", [1000, 0])
def test_blocks_by_tours(spark, local_arcs):
    rng = random.Random(7)
    names = rng.sample(range(-500, 500), 200)
    ring, ladder = [(i, (i + 1) % 60) for i in range(60)], [(60 + i, 62 + i) for i in range(50)] + [(60 + i, 61 + i) for i in range(0, 50, 14)]
    hub, tail = [(120, i) for i in range(121, 150)] + [(130, 131), (131, 132), (140, 141)], [(i, i + 1) for i in range(149, 180)] + [(10, 60)]
    edges = [(names[a], names[b]) for a, b in ring + ladder + hub + tail + [(181, 182)] + [(a + 183, b + 183) for a, b in random_edges(4, 16, 22)]]
    got, want, _ = _by_tables_and_by_search(spark, edges, deep=0, local_arcs=local_arcs)
    assert got == want


def test_blocks_in_a_row_has_its_invariants(spark):
    scratch = Scratch(spark, "test")
    for distinct in (True, False):
        g = generate.blocks_in_a_row(spark, 60, 150, blocks=4, distinct=distinct).canonical()
        stats = bi.block_stats(bi.block_members(bi.edge_blocks(Graph(scratch.cut(g.vertices), scratch.cut(g.edges)), scratch)), 60).first()
        assert (stats.blocks, stats.articulations, stats.largest) == (7, 6, 15)


def test_strong_components(spark):
    edges = random_edges(5, 18, 26)
    g = frame(spark, 18, edges, True).canonical()
    scratch = Scratch(spark, "test")
    reach = {s: {s} for s in range(18)}
    for _ in range(18):
        for u, v in edges:
            for s in reach:
                if u in reach[s]:
                    reach[s].add(v)
    want = {s: min(t for t in reach[s] if s in reach[t]) for s in range(18)}
    comps = strong_components(Graph(g.vertices, scratch.cut(g.edges), True), scratch)
    assert {r.id: r.comp for r in comps.collect()} == want
    weighted = Graph(g.vertices, g.edges.withColumn("weight", F.col("src") + F.col("dst")), True)
    bridges = scratch.cut(condensation(weighted, comps))
    cross = [(want[u], want[v], u + v, u, v) for u, v in set(edges) if want[u] != want[v]]
    assert {(r.s, r.t): (r.weight, r.eu, r.ev, r.bridges) for r in bridges.collect()} == {(s, t): (*min(c[2:] for c in cross if c[:2] == (s, t)), sum(c[:2] == (s, t) for c in cross)) for s, t in {c[:2] for c in cross}}
    level = {c: 0 for c in want.values()}
    for _ in level:
        for s, t, *_ in cross:
            level[t] = max(level[t], level[s] + 1)
    assert {r.comp: r.level for r in topological_levels(comps, bridges, scratch).collect()} == level


def test_redundant_kinds(spark):
    clique = [(u, v) for u in range(10, 14) for v in range(u + 1, 14)]
    got = {r.id: r.kind for r in redundant_vertices(frame(spark, 14, WHEEL + clique).canonical()).collect()}
    assert got == {0: "r4", 10: "r3", 11: "r3", 12: "r3", 13: "r3"}


def test_reports(spark):
    g = frame(spark, 5, [(0, 1), (1, 0), (1, 1), (1, 2)])
    assert tuple(graph_report(g, Scratch(spark, "test")).first()) == (5, 4, 3, 1, 1, 3)
    assert {r.id: r.degree for r in degrees(g.canonical()).collect()} == {0: 1, 1: 2, 2: 1, 3: 0, 4: 0}
    probes = spark.createDataFrame([(1, 0), (2, 0)], "src long, dst long")
    assert {(r.src, r.dst): r.present for r in edges_present(g, probes).collect()} == {(1, 0): True, (2, 0): False}


def test_comparisons(spark):
    a = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 1.0), ("b", 1, 0.0), ("b", 2, 1.0), ("c", 9, 1.0)], "method string, id long, closeness double")
    assert {(r.method_i, r.method_j): r.mse for r in method_mse(a).collect()} == {("a", "b"): 0.125, ("a", "c"): None, ("b", "c"): None}
    one, two = a.where("method = 'a'"), a.where("method = 'b'")
    assert tuple(max_abs_error(one, two).first()) == (2, 0.5, False)
    assert tuple(max_abs_error(one, one).first()) == (2, 0.0, True)
    assert [r.id for r in top_k(a.where("method <> 'c'"), 3).collect()] == [2, 2, 1]
    runs = spark.createDataFrame([("x", 1, 10.0), ("x", 1, 30.0), ("y", 1, 5.0)], "method string, n int, ms double")
    stats = run_stats(runs, ["method", "n"])
    assert {r.method: r.speedup for r in speedups(stats, ["n"], "x").collect()} == {"x": 1.0, "y": 4.0}


def test_generators(spark):
    tree = generate.connected(spark, 50, 70)
    assert tuple(graph_report(tree, Scratch(spark, "test")).first()) == (50, 70, 70, 0, 0, 1)
    plain = generate.uniform(spark, 30, 40)
    report = graph_report(plain, Scratch(spark, "test")).first()
    assert (report.m, report.unique_edges, report.self_loops) == (40, 40, 0)
    assert generate.uniform(spark, 30, 40).edges.exceptAll(plain.edges).isEmpty()
    with pytest.raises(ValueError):
        generate.connected(spark, 10, 5)
    with pytest.raises(ValueError):
        generate.uniform(spark, 4, 7)
    cliques = generate.chain_of_cliques(spark)
    assert (cliques.vertices.count(), cliques.edges.count()) == (48, 247)
    random = generate.random_directed(spark, 60, 0.1)
    assert 200 < random.edges.count() < 520 and random.edges.where("src = dst OR weight < 1 OR weight > 5.5").isEmpty()
    batch = generate.insert_batch(tree, 10)
    assert batch.count() == 10 and batch.join(tree.edges, ["src", "dst"], "left_semi").isEmpty()
