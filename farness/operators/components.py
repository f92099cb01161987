"""Connected components of an undirected edge table.

Up to local_edges edges, as counted, are joined in one task of an executor, in one pass. More go through alternating large-star and small-star
steps: every round is two aggregations (with partial sums before the shuffle) and two joins on a vertex; nothing is collected, and a
round's edges are written to the shared folder, so lineage stays short. Rounds grow with the logarithm of the component size.
Both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farness.scratch import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (src > dst, distinct). Large: greater neighbours to the least one; small: the rest likewise, each edge once."""
    ways = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else edges
    least = ways.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("root"))
    joined = ways.join(least, "src")
    if large:
        out = joined.where("dst > src").select(F.col("dst").alias("src"), F.col("root").alias("dst"))
    else:
        out = joined.select(F.explode(F.array("src", "dst")).alias("src"), F.col("root").alias("dst"))
    out = out.where("src > dst")
    return out if large else out.distinct()


def _joined_in_a_task(batches):
    import pyarrow as pa

    root: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ends = []
            for x in (a, b):
                path = []
                while (up := root.setdefault(x, x)) != x:
                    path.append(x)
                    x = up
                for y in path:
                    root[y] = x
                ends.append(x)
            root[max(ends)] = min(ends)
    # a root is less than what hangs on it, so in ascending order every parent is done before
    out: dict[int, int] = {}
    for x in sorted(root):
        out[x] = x if root[x] == x else out[root[x]]
    yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.int64())], ["id", "component"])


def connected_components(edges: DataFrame, scratch: Scratch | None = None, src: str = "src", dst: str = "dst", local_edges: int = 1_000_000) -> DataFrame:
    """(id, component) for every vertex with an edge to another one; component is the least id reachable.

    Ids are BIGINTs. Loops and edges with a null end are as absent; repeated edges count once. No edges give no rows.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    pairs = edges.select(F.greatest(src, dst).alias("src"), F.least(src, dst).alias("dst"), (F.col(src).isNotNull() & F.col(dst).isNotNull()).alias("whole"))
    now = scratch.cut(pairs.where("whole AND src > dst").select("src", "dst").distinct())
    if now.count() <= local_edges:
        return scratch.cut(now.coalesce(1).mapInArrow(_joined_in_a_task, "id long, component long"))
    before, mark = None, _mark(now)
    while mark[0] and mark != before:
        now = scratch.cut(_star(_star(now, True), False))
        before, mark = mark, _mark(now)
    roots = now.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(roots)
