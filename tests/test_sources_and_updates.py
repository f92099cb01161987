"""Edge lists and value files, updates, affected sources and the streaming adapter."""

from __future__ import annotations

import pytest

from farness.functions import strict_double
from farness.plans import closeness
from farness.scratch import Scratch
from farness.sources import append_timing, read_edge_list, read_values, write_edge_list, write_values
from farness.streaming import UpdateStream, affected_sources, apply_updates, refreshed, refreshed_directed
from tests.graphs import DISCO, frame, random_edges, sums

UPDATES = "op string, src long, dst long"


def rows(df):
    return {r.id: (r.r, r.d) for r in df.collect()}


def test_edge_list_round_trip(spark, tmp_path):
    g = frame(spark, *DISCO)
    write_edge_list(g, str(tmp_path / "g"))
    back = read_edge_list(spark, str(tmp_path / "g"))
    assert back.vertices.count() == 7 and sorted(map(tuple, back.edges.collect())) == DISCO[1]
    (tmp_path / "w.txt").write_text("3 2\n0 1 1.5\n\n 1\t2  2\n")
    assert sorted(map(tuple, read_edge_list(spark, str(tmp_path / "w.txt"), weighted=True).edges.collect())) == [(0, 1, 1.5), (1, 2, 2.0)]


@pytest.mark.parametrize("text", ["", "3\n0 1\n", "3 2\n0 1\n", "3 1\n0 3\n", "3 1\n0 x\n", "3 1\n0 1 2\n"])
def test_bad_edge_lists_raise(spark, tmp_path, text):
    (tmp_path / "bad.txt").write_text(text)
    with pytest.raises(ValueError):
        read_edge_list(spark, str(tmp_path / "bad.txt"))


def test_values_and_timings(spark, tmp_path):
    write_values(closeness(frame(spark, *DISCO), "bits"), str(tmp_path / "v"))
    got = spark.read.option("header", True).csv(str(tmp_path / "v"))
    assert got.columns == ["id", "closeness"] and got.count() == 7
    (tmp_path / "a.csv").write_text("0.5,x\n\nabc\n1e-3\n 2 ,\n3x\n")
    assert [r.value for r in read_values(spark, str(tmp_path / "a.csv")).orderBy("place").collect()] == [0.5, 0.001, 2.0]
    append_timing(spark, str(tmp_path / "t"), "bits", 12.5, n=7)
    append_timing(spark, str(tmp_path / "t"), "pairs", 20, n=7)
    assert {(r.method, r.ms, r.facts["n"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("bits", 12.5, "7"), ("pairs", 20.0, "7")}


def test_strict_double(spark):
    df = spark.createDataFrame([("1",), ("1.5e3",), ("1.5x",), ("",), (None,), ("-2",)], "t string")
    assert [r[0] for r in df.select(strict_double(df["t"])).collect()] == [1.0, 1500.0, None, None, None, -2.0]


def test_deletes_take_all_parallel_edges(spark):
    g = frame(spark, 3, [(0, 1, 1), (0, 1, 2), (1, 2, 1)], True)
    updates = spark.createDataFrame([("delete", 0, 1, None), ("insert", 2, 5, 7)], UPDATES + ", weight long")
    after = apply_updates(g, updates)
    assert sorted(map(tuple, after.edges.collect())) == [(1, 2, 1), (2, 5, 7)] and sorted(r.id for r in after.vertices.collect()) == [0, 1, 2, 5]
    undirected = apply_updates(frame(spark, 3, [(0, 1), (1, 2)]), spark.createDataFrame([("delete", 1, 0)], UPDATES))
    assert [tuple(r) for r in undirected.edges.collect()] == [(1, 2)]


def test_an_insert_between_strong_components_counts(spark):
    edges = [(0, 1, 1), (1, 0, 1), (2, 3, 1), (3, 2, 1)]
    after = apply_updates(frame(spark, 4, edges, True), spark.createDataFrame([("insert", 1, 2, 5)], UPDATES + ", weight long"))
    assert rows(closeness(after, "confined")) == sums(4, [*edges, (1, 2, 5)], True)


def test_affected_sources_hold_all_that_change(spark):
    edges = random_edges(2, 20, 18)
    scratch = Scratch(spark, "test")
    for u, v in ((0, 7), (3, 19)):
        got = {r.id for r in affected_sources(frame(spark, 20, edges), u, v, scratch).collect()}
        before, after = sums(20, edges), sums(20, [*edges, (u, v)])
        assert {s for s in range(20) if before[s] != after[s]} <= got


def test_refreshed_equals_full(spark):
    edges = [(0, 1), (1, 2), (3, 4), (5, 6), (6, 7)]
    g, scratch = frame(spark, 9, edges), Scratch(spark, "test")
    before = closeness(g, "bits")
    updates = spark.createDataFrame([("insert", 2, 3), ("delete", 7, 6)], UPDATES)
    assert rows(refreshed(g, before, updates, scratch)) == sums(9, [(0, 1), (1, 2), (3, 4), (5, 6), (2, 3)])


def test_update_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    got = {}
    stream = UpdateStream(frame(spark, 4, [(0, 1)]), lambda df, number: got.__setitem__(number, rows(df)))
    for k, batch in enumerate(([("insert", 1, 2)], [("insert", 2, 3), ("delete", 0, 1)])):
        spark.createDataFrame(batch, UPDATES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = stream.start(spark.readStream.schema(UPDATES).parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
        assert query.exception() is None
    assert got == {0: sums(4, [(0, 1), (1, 2)]), 1: sums(4, [(1, 2), (2, 3)])}


def test_an_update_stream_goes_on_after_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    got, start = {}, frame(spark, 5, [(0, 1)])
    for k, batch in enumerate(([("insert", 1, 2)], [("insert", 2, 3)], [("insert", 3, 4), ("delete", 0, 1)])):
        # a new object each time, as after a restart, that knows the first graph only
        stream = UpdateStream(start, lambda df, number: got.__setitem__(number, rows(df)))
        spark.createDataFrame(batch, UPDATES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = stream.start(spark.readStream.schema(UPDATES).parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
        assert query.exception() is None
    assert got == {0: sums(5, [(0, 1), (1, 2)]), 1: sums(5, [(0, 1), (1, 2), (2, 3)]), 2: sums(5, [(1, 2), (2, 3), (3, 4)])}
    # a batch that is asked for again gives the same
    again = UpdateStream(start, lambda df, number: got.__setitem__(f"again {number}", rows(df)))
    again.state = f"{tmp_path}/checkpoint/graph"
    again(spark.createDataFrame(batch, UPDATES), 2)
    assert got["again 2"] == got[2]


@pytest.mark.parametrize("few", [0, 1])
def test_refreshed_batches_equal_full(spark, few):
    edges = random_edges(4, 24, 26)
    updates = [("insert", 0, 9), ("insert", 3, 17), ("delete", *edges[2]), ("delete", *edges[7][::-1]), ("insert", 5, 30)]
    scratch = Scratch(spark, "test")
    g = frame(spark, 24, edges)
    got = rows(refreshed(g, closeness(g, "bits"), spark.createDataFrame(updates, UPDATES), scratch, few))
    left = [e for e in edges if e not in (edges[2], edges[7]) and e[::-1] not in (edges[2], edges[7])]
    want = sums(31, [*left, (0, 9), (3, 17), (5, 30)])
    assert got == {i: want[i] for i in [*range(24), 30]}


def test_refreshed_directed_equals_full(spark):
    edges = [(a, b, 1 + (a * b) % 3) for a, b in random_edges(5, 20, 40)]
    updates = [("insert", 3, 11, 1), ("delete", edges[0][0], edges[0][1], None), ("insert", 19, 25, 2)]
    scratch = Scratch(spark, "test")
    g = frame(spark, 20, edges, True)
    got = rows(refreshed_directed(g, closeness(g, "weighted"), spark.createDataFrame(updates, UPDATES + ", weight long"), scratch))
    want = sums(26, [*(e for e in edges if e[:2] != edges[0][:2]), (3, 11, 1), (19, 25, 2)], True)
    assert got == {i: want[i] for i in [*range(20), 25]}
