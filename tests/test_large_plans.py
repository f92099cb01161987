"""Queries under the plans that larger tables get."""

from __future__ import annotations

import os

import pytest

from farness import queries, queries_more

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_methods_are_compared_without_broadcasts(no_broadcast):
    assert [tuple(r) for r in queries.QUERIES["method_mse"](no_broadcast, DATA).collect()] == [("bits", "blocks", 0.0)]


def test_forest_has_the_edges_of_its_sql(spark):
    tables = ("nation", "customer", "supplier")
    one, two = (queries.rows_of(spark, DATA, sql, tables) for sql in (queries_more.FOREST, queries_more.FOREST_EDGES))
    assert one.count() == two.count() > 0 and one.exceptAll(two).isEmpty()
