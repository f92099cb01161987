"""Edge updates: batches applied to a graph, the sources they affect, and a Structured Streaming adapter."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farness.graph import Graph
from farness.operators.components import connected_components
from farness.operators.local import Adjacency, _rows_of, adjacency, weak_components
from farness.operators.traverse import bfs_pairs, least_sums, msbfs_sums, pair_sums
from farness.operators.twins import folded
from farness.operators.whole import Whole, folded_sums, gathered
from farness.plans import closeness
from farness.scratch import Scratch, delete

#: Updates of a batch whose ends one pass on the driver searches from, at most.
MOST_UPDATES = 64


def apply_updates(graph: Graph, updates: DataFrame) -> Graph:
    """The graph after updates (op 'insert' or 'delete', src, dst and, if weighted, weight): deletes first, of all parallel edges.

    Undirected edges are deleted in either direction; the ends of inserted edges become vertices.
    """
    gone = updates.where("op = 'delete'").select("src", "dst")
    new = updates.where("op = 'insert'").select("src", "dst", *(["weight"] * graph.weighted))
    if graph.ends and gone.isEmpty():
        return Graph.of_edges(graph.edges.unionByName(new), graph.directed)
    if not graph.directed:
        gone = gone.unionByName(gone.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    vertices = graph.vertices.select("id").unionByName(new.select(F.explode(F.array("src", "dst")).alias("id"))).distinct()
    return Graph(vertices, graph.edges.join(gone.distinct(), ["src", "dst"], "left_anti").unionByName(new), graph.directed)


def affected_sources(graph: Graph, u, v, scratch: Scratch) -> DataFrame:
    """(id) of the sources whose distances may change when the undirected edge u-v comes: those at distances to u and v that differ
    by more than one, or that reach just one of them."""
    ends = graph.vertices.where(F.col("id").isin(u, v))
    pairs = bfs_pairs(scratch.cut(graph.canonical().arcs()), ends, scratch)
    to = pairs.groupBy(F.col("v").alias("id")).agg(F.min(F.when(F.col("source") == u, F.col("d"))).alias("du"), F.min(F.when(F.col("source") == v, F.col("d"))).alias("dv"))
    return to.where("du IS NULL OR dv IS NULL OR abs(du - dv) > 1").select("id")


def affected_by_batch(graph: Graph, updates: DataFrame, scratch: Scratch) -> DataFrame:
    """(id) of the sources whose distances may change by a batch of updates of an undirected graph.

    From any other source the ends of every new edge are at most one apart (or both out of reach) and those of every deleted edge equally
    far; then its old distances hold in the new graph too, however many edges come and go.
    """
    ends = updates.select("op", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("w")).where("u <> w").distinct()
    sources = scratch.cut(ends.select(F.explode(F.array("u", "w")).alias("id")).distinct())
    known = scratch.cut(graph.canonical().arcs())
    pairs = scratch.cut(bfs_pairs(known, sources, scratch, True))
    near = lambda end, d: pairs.select(F.col("source").alias(end), F.col("v").alias("id"), F.col("d").alias(d))
    reached = ends.join(near("u", "du"), "u").unionByName(ends.join(near("w", "dw"), "w"), allowMissingColumns=True)
    both = reached.groupBy("op", "u", "w", "id").agg(F.max("du").alias("du"), F.max("dw").alias("dw"))
    changed = "du IS NULL OR dw IS NULL OR op = 'insert' AND abs(du - dw) > 1 OR op = 'delete' AND du <> dw"
    return both.where(changed).select("id").distinct()


def _hops(graph: Adjacency, source: int) -> np.ndarray:
    """Hop distances from a vertex; -1 out of reach."""
    out, frontier, level = np.full(graph.out.size - 1, -1), np.array([source]), 0
    while frontier.size:
        out[frontier] = level
        to = np.unique(graph.targets[_rows_of(graph.out, frontier)[1]])
        frontier, level = to[out[to] < 0], level + 1
    return out


def _changed(before: Whole, after: Whole, updates: list[tuple[str, int, int]]) -> np.ndarray:
    """Which vertices of after affected_by_batch() names, and those that are new."""
    arcs, order = adjacency(before.ids.size, *before.arcs()[:2], None)
    number = np.argsort(order)
    nowhere = np.full(before.ids.size, -1)
    ends = np.unique([x for _, u, w in updates for x in (u, w)])
    at = np.searchsorted(before.ids, ends)
    far = {x: _hops(arcs, number[k])[number] if k < before.ids.size and before.ids[k] == x else nowhere for x, k in zip(ends.tolist(), at.tolist(), strict=True)}
    changed = np.zeros(before.ids.size, bool)
    for op, u, w in updates:
        du, dw = far[u], far[w]
        apart = np.abs(du - dw) > 1 if op == "insert" else du != dw
        changed |= ((du < 0) != (dw < 0)) | ((du >= 0) & (dw >= 0) & apart)
    return np.isin(after.ids, before.ids[changed]) | ~np.isin(after.ids, before.ids)


def _refreshed_arrays(graph: Graph, after: Graph, before: DataFrame, updates: DataFrame, few: float) -> DataFrame | None:
    """refreshed() where many sources are affected, of graphs that can be gathered and batches whose searches are few; else None."""
    spark = graph.edges.sparkSession
    ends = updates.where("src <> dst").select("op", "src", "dst").distinct().limit(MOST_UPDATES + 1).collect()
    if graph.weighted or len(ends) > MOST_UPDATES or (old := gathered(graph)) is None or (new := gathered(after)) is None:
        return None
    changed = _changed(old, new, [tuple(r) for r in ends]) if ends else np.zeros(new.ids.size, bool)
    if changed.sum() <= few * new.ids.size:
        return None
    label = weak_components(new.ids.size, new.src, new.dst)
    again = np.isin(label, np.unique(label[changed]))
    sums = folded_sums(spark, new.part(again))
    if again.all():
        return sums
    zero = F.lit(0).cast("long")
    taken = spark.createDataFrame(pa.table({"id": new.ids[~again]})).join(before.select("id", "r", "d"), "id", "left")
    return sums.unionByName(taken.select("id", F.coalesce("r", zero).alias("r"), F.coalesce("d", zero).alias("d")))


def refreshed(graph: Graph, before: DataFrame, updates: DataFrame, scratch: Scratch, few: float = 1 / 64) -> DataFrame:
    """(id, r, d) of an undirected graph after updates, from (id, r, d) of the graph before; rows of unaffected sources are taken over.

    Up to a share of `few` affected sources are traversed one by one; more are by traversing whole components that an update touches.
    """
    after = apply_updates(graph, updates)
    if (arrays := _refreshed_arrays(graph, after, before, updates, few)) is not None:
        return arrays
    after = after.canonical()
    after = Graph(scratch.cut(after.vertices), scratch.cut(after.edges))
    old = before.select("id", "r", "d")
    affected = scratch.cut(affected_by_batch(graph, updates, scratch).unionByName(after.vertices.join(graph.vertices, "id", "left_anti").select("id")).distinct())
    zero = F.lit(0).cast("long")
    taken = lambda again: after.vertices.join(again.select("id"), "id", "left_anti").join(old, "id", "left").select("id", F.coalesce("r", zero).alias("r"), F.coalesce("d", zero).alias("d"))
    if affected.count() <= few * after.vertices.count():
        pairs = bfs_pairs(scratch.cut(after.arcs()), affected, scratch, True)
        return pair_sums(pairs).select("id", "r", F.col("d").cast("long").alias("d")).unionByName(taken(affected))
    of = scratch.cut(after.vertices.join(connected_components(after.edges, scratch), "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    comps = of.join(affected, "id", "left_semi").select("component").distinct()
    again = scratch.cut(of.join(comps, "component", "left_semi").select("id"))
    few = folded(Graph(again, scratch.cut(after.edges.join(again.withColumnRenamed("id", "src"), "src", "left_semi"))), scratch)
    sums = msbfs_sums(scratch.cut(few.graph.arcs()), few.graph.vertices, scratch, True, mass=few.mass)
    return few.unfolded(sums, scratch).unionByName(taken(again))


def refreshed_directed(graph: Graph, before: DataFrame, updates: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, r, d) of a directed weighted graph after updates: only vertices that reach the start of an updated arc, before or after,
    are traversed again (the strong components that an update touches, and their ancestors); the other rows are taken over."""
    after = apply_updates(graph, updates).canonical()
    after = Graph(scratch.cut(after.vertices), scratch.cut(after.edges), True)
    both = scratch.cut(graph.edges.select("src", "dst").unionByName(after.edges.select("src", "dst")).where("src <> dst").distinct())
    back = both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    state = scratch.cut(updates.select(F.col("src").alias("id")).distinct())
    frontier = state
    while not frontier.isEmpty():
        step = frontier.join(back, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = scratch.cut(step.join(state, "id", "left_anti"))
        state = scratch.cut(state.unionByName(frontier))
    again = scratch.cut(after.vertices.join(state, "id", "left_semi"))
    new = least_sums(after.edges, after.vertices, scratch, sources=again)
    kind = dict(new.dtypes)["d"]
    old = after.vertices.join(again, "id", "left_anti").join(before.select("id", "r", "d"), "id", "left")
    return new.unionByName(old.select("id", F.coalesce("r", F.lit(0).cast("long")).alias("r"), F.coalesce("d", F.lit(0)).cast(kind).alias("d")))


class UpdateStream:
    """Applies each micro-batch of an update stream and hands the closeness of the graph after it to a sink.

    The vertices and edges after each batch are tables in a folder of the checkpoint, named by the batch; a stream that is started again
    with that checkpoint, in whatever session, goes on from the last whole one. A batch run again is applied to the tables
    before it, so it gives the same result.
    """

    def __init__(self, graph: Graph, sink: Callable[[DataFrame, int], None], method: str = "bits", normalization: str | None = None):
        self.graph, self.sink, self.method, self.normalization = graph, sink, method, normalization
        self.spark, self.state = graph.vertices.sparkSession, None

    def _batches(self) -> list[int]:
        """Batches whose tables are whole, in order."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.state).getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(path(self.state))] if files.exists(path(self.state)) else []
        # edges are written after vertices
        return sorted(int(n.partition("-")[2]) for n in names if n.startswith("edges-") and files.exists(path(f"{self.state}/{n}/_SUCCESS")))

    def _at(self, number: int) -> Graph:
        read = lambda name: self.spark.read.parquet(f"{self.state}/{name}-{number}")
        return Graph(read("vertices"), read("edges"), self.graph.directed)

    def before(self, number: int) -> Graph:
        """The graph that batch `number` is applied to."""
        done = [n for n in self._batches() if n < number]
        return self._at(done[-1]) if done else self.graph

    def __call__(self, batch: DataFrame, number: int) -> None:
        if self.state is None:
            self.state = Scratch(self.spark, "updates").path("graph")
        if number not in self._batches():
            after = apply_updates(self.before(number), batch)
            after.vertices.write.mode("overwrite").parquet(f"{self.state}/vertices-{number}")
            after.edges.write.mode("overwrite").parquet(f"{self.state}/edges-{number}")
        self.sink(closeness(self._at(number), self.method, self.normalization), number)
        # the batch before may still be asked for again, older ones not
        for old in [n for n in self._batches() if n < number - 1]:
            for name in ("edges", "vertices"):
                delete(self.spark, f"{self.state}/{name}-{old}")

    def start(self, updates: DataFrame, checkpoint: str, **trigger):
        """Starts a query over a streaming DataFrame of updates; checkpoint is a folder that driver and executors share."""
        self.state = f"{checkpoint.rstrip('/')}/graph"
        return updates.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
