"""Graphs of up to LOCAL_ARCS edges, as counted, gathered as arrays, so that few jobs are left to run.

The driver only sorts: it numbers the vertices, drops loops and parallel edges and folds twins (twins.py, by the same rule). Traversals of the
folded graph are dealt to tasks that know the whole of it (local.py), and the rows of all vertices are laid out by tasks. Larger graphs and
ids or weights of other types go by tables; both ways give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farness.graph import Graph
from farness.operators import local


@dataclass(frozen=True)
class Whole:
    """A canonical graph. ids ascend; src and dst (and weight) are edges between their places, src < dst if undirected."""

    ids: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    weight: np.ndarray | None
    directed: bool

    def arcs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        if self.directed:
            return self.src, self.dst, self.weight
        return np.concatenate([self.src, self.dst]), np.concatenate([self.dst, self.src]), None if self.weight is None else np.concatenate([self.weight] * 2)

    def part(self, keep: np.ndarray) -> Whole:
        """The graph of the vertices marked by keep and the edges between them."""
        number = np.cumsum(keep) - 1
        inside = keep[self.src] & keep[self.dst]
        return Whole(self.ids[keep], number[self.src[inside]], number[self.dst[inside]], None if self.weight is None else self.weight[inside], self.directed)

    def frames(self, spark: SparkSession) -> Graph:
        columns = {"src": self.ids[self.src], "dst": self.ids[self.dst]} | ({} if self.weight is None else {"weight": self.weight})
        return Graph(spark.createDataFrame(pa.table({"id": self.ids})), spark.createDataFrame(pa.table(columns)), self.directed)


def canonical(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray | None, directed: bool) -> Whole:
    """Without loops and parallel edges, of which the least weight stays; src and dst are places in ids."""
    if not directed:
        src, dst = np.minimum(src, dst), np.maximum(src, dst)
    order = np.lexsort((dst, src) if weight is None else (weight, dst, src))
    order = order[src[order] != dst[order]]
    src, dst = src[order], dst[order]
    fresh = np.flatnonzero(np.concatenate([[True], (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])])) if src.size else np.zeros(0, np.int64)
    return Whole(ids, src[fresh], dst[fresh], None if weight is None else weight[order][fresh], directed)


def gathered(graph: Graph, most: int | None = None) -> Whole | None:
    """The canonical graph as arrays; None for more edges or vertices than `most` (LOCAL_ARCS), and for other types than numbers."""
    most = local.LOCAL_ARCS if most is None else most
    kinds = dict(graph.edges.dtypes)
    real = kinds.get("weight") in ("double", "float")
    if {kinds["src"], kinds["dst"], dict(graph.vertices.dtypes)["id"]} != {"bigint"} or graph.weighted and not real and kinds["weight"] not in ("bigint", "int"):
        return None
    if graph.edges.count() > most or not graph.ends and graph.vertices.count() > most:
        return None
    found = graph.edges.select("src", "dst", *([F.col("weight").cast("double" if real else "long")] * graph.weighted)).toArrow()
    ids = graph.vertices.select("id").toArrow().column(0) if not graph.ends else pa.chunked_array([*found.column("src").chunks, *found.column("dst").chunks], pa.int64())
    ids = np.unique(ids.drop_null().to_numpy())
    found = found.filter(pc.and_(pc.is_valid(found.column("src")), pc.is_valid(found.column("dst"))))
    weight = None
    if graph.weighted:
        if found.column("weight").null_count:
            return None
        weight = found.column("weight").to_numpy()
        if real and np.isnan(weight).any():
            return None
    ends = [found.column(c).to_numpy() for c in ("src", "dst")]
    places = [np.searchsorted(ids, x) for x in ends]
    if any((at >= ids.size).any() or (ids[at] != x).any() for at, x in zip(places, ends, strict=True)):
        return None
    return canonical(ids, *places, weight, graph.directed)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(graph: Whole) -> tuple[np.ndarray, np.ndarray]:
    """(the first of the twins of each vertex, or itself; its mass, 0 for the third and further of a class)."""
    n = graph.ids.size
    first, mass = np.arange(n), np.ones(n, np.int64)
    owner = np.concatenate([graph.src, graph.dst])
    near = np.concatenate([2 * graph.dst, 2 * graph.src + int(graph.directed)])
    weight = np.zeros(owner.size, np.int64) if graph.weight is None else np.concatenate([graph.weight] * 2).view(np.int64)
    order = np.lexsort((near, owner))
    owner, near, weight = owner[order], near[order], weight[order]
    size = np.bincount(owner, minlength=n)
    offsets = np.concatenate([[0], np.cumsum(size)])
    some = np.flatnonzero(size)
    if not some.size:
        return first, mass
    hashes = [np.add.reduceat(_mixed(_mixed(near.astype(np.uint64) + np.uint64(salt)) + weight.view(np.uint64)), offsets[some]) for salt in (1 << 40, 3 << 41)]
    by = np.lexsort((*hashes, size[some]))
    marks = [x[by] for x in (*hashes, size[some])]
    begin = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in marks], axis=0)]))
    count = np.diff(np.append(begin, some.size))
    group = np.repeat(np.arange(begin.size), count)
    member, head = some[by], some[by[begin]][group]
    alike = np.flatnonzero(count[group] > 2)
    member, head, group = member[alike], head[alike], group[alike]
    # each neighbour of a class is one of all its members
    which, at = local._rows_of(offsets, member)
    other = at - offsets[member][which] + offsets[head][which]
    odd = np.unique(group[which[(near[at] != near[other]) | (weight[at] != weight[other])]])
    good = ~np.isin(group, odd)
    member, head = member[good], head[good]
    first[member] = head
    own = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if head.size else np.zeros(0, np.int64)
    # members ascend within a class, since sorting is stable
    mass[member] = 0
    mass[head[own]] = 1
    mass[member[own + 1]] = np.diff(np.append(own, member.size)) - 1
    return first, mass


def _dealt(spark: SparkSession, units: list, shared: tuple, work, schema: str) -> DataFrame:
    """Rows of work(units of the task, *shared) over tasks; vertices without a neighbour aren't work."""
    units = [u for u in units if u[1] - u[0] > 1]
    tasks = max(1, min(len(units), 3 * spark.sparkContext.defaultParallelism))
    sent = spark.sparkContext.broadcast((units, shared))

    def run(batches):
        units, shared = sent.value
        for batch in batches:
            for task in batch.column(0).to_pylist():
                for columns in work(units[task::tasks], *shared):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["v", "r", "d"])

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, schema)


def _spread_from(units, graph, mass):
    r, d = np.zeros(mass.size, np.int64), np.zeros(mass.size, np.int64)
    for unit in units:
        local.spread(graph, *unit, r, d, mass)
    some = np.flatnonzero(r)
    yield some, r[some], d[some]


def _relaxed_from(units, graph, mass, wanted):
    for low, high, first, last in units:
        own = first + np.flatnonzero(wanted[first:last])
        if own.size:
            r, d = local.sums_of(graph, low, high, own, mass)
            yield own, r.astype(np.int64), d


def sums(spark: SparkSession, graph: Whole, mass: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(r, d) of each vertex, out of it along edges: of hops without weights, else of least sums of weights; those not wanted may be 0."""
    src, dst, weight = graph.arcs()
    if weight is None:
        src, dst = dst, src
    adjacency, order = local.adjacency(graph.ids.size, src, dst, weight)
    if weight is None:
        units = local._units(adjacency.bounds, lambda k: 64 * max(1, min(8, (2 << 20) // k)))
        rows = _dealt(spark, units, (adjacency, mass[order]), _spread_from, "v long, r long, d long")
        if graph.ids.size > 100_000:
            rows = rows.groupBy("v").agg(F.sum("r").alias("r"), F.sum("d").alias("d"))
    else:
        wanted = np.ones(graph.ids.size, bool) if wanted is None else wanted
        units = local._units(adjacency.bounds, lambda k: max(64, min(4096, -(-k // 48))))
        rows = _dealt(spark, units, (adjacency, mass[order], wanted[order]), _relaxed_from, f"v long, r long, d {'double' if weight.dtype.kind == 'f' else 'long'}")
    found = rows.toArrow()
    r, d = np.zeros(graph.ids.size, np.int64), np.zeros(graph.ids.size, np.int64 if weight is None else weight.dtype)
    at = order[found.column(0).to_numpy()]
    np.add.at(r, at, found.column(1).to_numpy())
    np.add.at(d, at, found.column(2).to_numpy())
    return r, d


def laid_out(spark: SparkSession, ids: np.ndarray, place: np.ndarray, r: np.ndarray, d: np.ndarray) -> DataFrame:
    """(id, r, d) with a row for each of ids, whose values are at its place."""
    sent = spark.sparkContext.broadcast((ids, place.astype(np.int32), r, d))

    def run(batches):
        ids, place, r, d = sent.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[at], r[place[at]], d[place[at]])], ["id", "r", "d"])

    tasks = max(1, min(spark.sparkContext.defaultParallelism, ids.size // 20_000))
    return spark.range(0, ids.size, 1, tasks).mapInArrow(run, f"id long, r long, d {'double' if d.dtype.kind == 'f' else 'long'}")


def folded_sums(spark: SparkSession, graph: Whole, by_tables=None) -> DataFrame:
    """(id, r, d) of all vertices by way of the folded graph; by_tables(graph, mass), if given, makes (id, r, d) of that."""
    first, mass = fold(graph)
    kept = mass > 0
    few, heavy = graph.part(kept), mass[kept]
    if by_tables is None:
        r, d = sums(spark, few, heavy)
    else:
        more = np.flatnonzero(heavy > 1)
        masses = spark.createDataFrame(pa.table({"v": few.ids[more], "mass": heavy[more]})) if more.size else None
        found = by_tables(few.frames(spark), masses).select("id", "r", "d").toArrow()
        at = np.searchsorted(few.ids, found.column(0).to_numpy())
        r, d = np.zeros(few.ids.size, np.int64), np.zeros(few.ids.size, np.float64 if pa.types.is_floating(found.column(2).type) else np.int64)
        r[at], d[at] = found.column(1).to_numpy(), found.column(2).to_numpy()
    return laid_out(spark, graph.ids, (np.cumsum(kept) - 1)[first], r, d)
