"""Registered graph queries against their SQL on the smallest tables; the entry works with and without the optional parts."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from farness import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def equal(spark, duck, run, sql):
    got, want = run(spark, DATA), duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["degree", "closeness_wf", "closeness_blocks", "closeness_r3r4", "block_stats", "condensation_bridges", "topological_order", "delete_batch_closeness", "edge_probes"])
def test_query_equals_sql(spark, duck, name):
    equal(spark, duck, queries.QUERIES[name], queries.ORACLES[name])


def test_blocks_by_search_and_by_tables_are_the_same(spark):
    one, two = (queries.QUERIES[f"bcc_edges_by_{x}"](spark, DATA) for x in ("search", "tables"))
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_entry(spark):
    assert entry_module.entry(spark).count() == 10
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
