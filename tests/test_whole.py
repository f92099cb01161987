"""Graphs gathered as arrays: the same rows as by tables, in a few jobs."""

from __future__ import annotations

import random

import pytest

from farness.graph import Graph
from farness.operators import local, traverse
from farness.operators.blocks import sums_in_blocks
from farness.plans import closeness
from farness.scratch import Scratch
from farness.streaming import apply_updates, refreshed


def _graph(spark, directed: bool, seed: int) -> Graph:
    rng = random.Random(seed)
    edges = [(rng.randrange(25), rng.randrange(25), rng.randrange(1, 5)) for _ in range(45)]
    # twins of several kinds, loops, parallel edges and ends that are missing
    edges += [(0, 100 + k, 2) for k in range(6)] + [(200 + k, 1 + k % 2, 1) for k in range(7)] + [(300 + k, x, 3) for k in range(5) for x in (3, 4)]
    edges += [(5, 5, 1), (0, 100, 1), (700, 700, 1), (None, 3, 1), (2, None, 1), (900, 901, 4)]
    vertices = [(x,) for x in {v for a, b, _ in edges for v in (a, b)} | {555}]
    frame = spark.createDataFrame(edges, "src long, dst long, weight long")
    return Graph(spark.createDataFrame(vertices, "id long"), frame if directed else frame.select("src", "dst"), directed)


def _rows(df) -> list:
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("method", ["pairs", "bits", "weighted"])
def test_arrays_give_what_tables_give(spark, monkeypatch, method):
    graph = _graph(spark, method == "weighted", 7)
    found = _rows(closeness(graph, method))
    ends = _rows(closeness(Graph.of_edges(graph.edges, graph.directed), method, "reachable"))
    monkeypatch.setattr(local, "LOCAL_ARCS", 0)
    monkeypatch.setattr(traverse, "LOCAL_ARCS", 0)
    assert found == _rows(closeness(graph, method))
    assert ends == _rows(closeness(Graph.of_edges(graph.edges, graph.directed), method, "reachable"))


def jobs_of(spark, group: str, run) -> int:
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize(("method", "most"), [("bits", 12), ("pairs", 45), ("reduced", 60)])
def test_few_jobs(spark, method, most):
    graph = Graph.of_edges(spark.createDataFrame([(k % 3, 10 + k) for k in range(60)] + [(0, 1), (1, 2)], "src long, dst long"))
    n = jobs_of(spark, f"few-{method}", lambda: closeness(graph, method).collect())
    assert n <= most


def test_inserts_are_few_jobs(spark):
    graph = Graph.of_edges(spark.createDataFrame([(k % 3, 10 + k) for k in range(60)] + [(0, 1)], "src long, dst long"))
    after = apply_updates(graph, spark.createDataFrame([("insert", 1, 2), ("insert", 2, 99)], "op string, src long, dst long"))
    assert after.ends and after.edges.count() == 63 and {99, 69} < {r.id for r in after.vertices.collect()}
    assert jobs_of(spark, "few-inserts", lambda: closeness(after).collect()) <= 12


def test_blocks_of_few_edges_are_summed_in_a_task(spark):
    for seed in range(40):
        rng = random.Random(seed)
        edges = sorted({(min(e), max(e)) for e in ((rng.randrange(18), rng.randrange(18)) for _ in range(rng.randrange(4, 26))) if e[0] != e[1]})
        near: dict = {}
        for a, b in edges:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        mass = {v: rng.randrange(2, 9) for v in near if rng.random() < 0.3}
        want = []
        for v in near:
            known, frontier = {v: 0}, [v]
            for u in frontier:
                for w in near[u]:
                    if w not in known:
                        known[w] = known[u] + 1
                        frontier.append(w)
            want.append((v, sum(mass.get(w, 1) for w in known if w != v), sum(mass.get(w, 1) * d for w, d in known.items())))
        assert sorted(sums_in_blocks([a for a, _ in edges], [b for _, b in edges], mass)) == sorted(want)
        assert sums_in_blocks([a for a, _ in edges], [b for _, b in edges], mass, 1) is None
    graph = Graph.of_edges(spark.createDataFrame([(k % 3, 10 + k) for k in range(60)] + [(0, 1), (1, 2)], "src long, dst long"))
    assert jobs_of(spark, "few-blocks", lambda: closeness(graph, "blocks").collect()) <= 12


def test_refreshed_by_arrays(spark):
    graph = Graph.of_edges(spark.createDataFrame([(k % 3, 10 + k) for k in range(30)] + [(0, 1), (500, 501), (501, 502), (600, 600)], "src long, dst long"))
    updates = spark.createDataFrame([("insert", 1, 2), ("delete", 0, 10 + 3), ("insert", 2, 99), ("insert", 7, 7)], "op string, src long, dst long")
    want = _rows(closeness(apply_updates(graph, updates)).select("id", "r", "d"))
    before = closeness(graph).select("id", "r", "d")
    found = []
    assert jobs_of(spark, "few-refreshed", lambda: found.extend(_rows(refreshed(graph, before, updates, Scratch(spark, "refreshed-arrays"), 0.0)))) <= 30
    assert found == want and len(found) == 39
