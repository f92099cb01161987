"""Messages between blocks and sums over strong components: both ways against a search, and deep trees."""

from __future__ import annotations

import time

import pytest

from farness.graph import Graph
from farness.operators import blocks, strong
from farness.plans import closeness
from farness.scratch import Scratch
from farness.sources import generate


def rows(df):
    return sorted((r.id, r.r, r.d) for r in df.collect())


def path(spark, n):
    return Graph(spark.range(n), spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst"))


def test_messages_of_tables_and_of_a_task_are_the_same(spark, monkeypatch):
    tree = spark.range(1, 30).selectExpr("id AS src", "CAST(id / 3 AS BIGINT) AS dst")
    rings = spark.createDataFrame([e for i in range(0, 30, 5) for e in ((i, i + 100), (i + 100, i + 200), (i + 200, i))], "src long, dst long")
    graph = Graph.of_edges(tree.unionByName(rings).unionByName(spark.range(1).selectExpr("500L AS src", "501L AS dst")))
    want = rows(closeness(graph, "bits"))
    assert rows(closeness(graph, "blocks")) == want
    monkeypatch.setattr(blocks._messages, "__defaults__", (0,))
    assert rows(closeness(graph, "blocks")) == want


def test_a_long_path_takes_no_more_rounds(spark):
    took = {}
    for n in (20, 20, 200):
        began = time.perf_counter()
        got = rows(closeness(path(spark, n), "blocks"))
        took[n] = time.perf_counter() - began
        assert got == [(i, n - 1, i * (i + 1) // 2 + (n - 1 - i) * (n - i) // 2) for i in range(n)]
    assert took[200] < 2 * took[20] + 2


@pytest.mark.parametrize("local_rows", [1 << 40, 0])
def test_confined_sums_equal_relaxation(spark, local_rows):
    graph = generate.chain_of_cliques(spark, 4, 4)
    forest = Graph(graph.vertices.unionByName(spark.range(100, 104)), graph.edges.unionByName(spark.createDataFrame([(5, 100, 3.0), (100, 101, 1.0), (101, 100, 2.0), (0, 102, 4.0)], "src long, dst long, weight double")), True)
    scratch = Scratch(spark, "test")
    plain = Graph(scratch.cut(forest.vertices), scratch.cut(forest.edges), True)
    assert strong.forest_of_components(strong.condensation(plain, strong.strong_components(plain, scratch)))
    assert rows(strong.confined_sums(plain, scratch, local_rows)) == rows(closeness(plain, "weighted"))
