"""Closeness of every vertex by any of the methods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farness.functions import closeness_of
from farness.graph import Graph
from farness.operators.blocks import block_sums
from farness.operators.redundant import reduced_sums
from farness.operators.strong import confined_sums, directed_sums
from farness.operators.traverse import bfs_pairs, msbfs_sums, pair_sums
from farness.operators.twins import folded
from farness.operators.whole import folded_sums, gathered
from farness.scratch import Scratch


@dataclass(frozen=True)
class Method:
    """How sums are made, and the normalization that goes with it by default."""

    sums: object
    normalization: str
    directed: bool = False
    arrays: bool = False  # whether its sums are those of whole.sums()


def _pairs(graph: Graph, scratch: Scratch, mass: DataFrame | None = None) -> DataFrame:
    return pair_sums(bfs_pairs(scratch.cut(graph.arcs()), graph.vertices, scratch, not graph.directed), mass)


def _bits(graph: Graph, scratch: Scratch, mass: DataFrame | None = None) -> DataFrame:
    return msbfs_sums(scratch.cut(graph.reversed().arcs() if graph.directed else graph.arcs()), graph.vertices, scratch, not graph.directed, mass=mass)


#: pairs: a row for each source and vertex; bits: 64 sources a row; reduced: without redundant sources; blocks: confined to
#: biconnected blocks; weighted and confined: directed graphs, over all pairs or confined to strong components.
METHODS = {
    "pairs": Method(_pairs, "classic"),
    "bits": Method(_bits, "wf", arrays=True),
    "reduced": Method(reduced_sums, "classic"),
    "blocks": Method(lambda graph, scratch, mass=None: block_sums(graph, scratch, mass=mass), "wf"),
    "weighted": Method(directed_sums, "reachable", True, arrays=True),
    "confined": Method(lambda graph, scratch, mass=None: confined_sums(graph, scratch, mass=mass), "reachable", True),
}


def closeness(graph: Graph, method: str = "bits", normalization: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(id, r, d, closeness) for every vertex: others reached, the sum of their distances, and closeness by the normalization.

    Every method runs on the graph folded by its twins (operators/twins.py). Distances of directed graphs go out of the vertex. Loops and parallel edges don't matter; isolated vertices get 0, 0, 0.0.
    """
    scratch = scratch or Scratch(graph.vertices.sparkSession, "closeness")
    plan = METHODS[method]
    if plan.directed and not graph.directed:
        graph = Graph(graph.vertices, graph.canonical().arcs(), True)
    if plan.directed and not graph.weighted:
        graph = Graph(graph.vertices, graph.edges.withColumn("weight", F.lit(1).cast("long")), True, graph.ends)
    spark = graph.vertices.sparkSession
    if plan.arrays and not plan.directed and graph.weighted:
        graph = Graph(graph.vertices, graph.edges.select("src", "dst"), graph.directed, graph.ends)
    if (whole := gathered(graph)) is not None:
        sums = folded_sums(spark, whole, None if plan.arrays else lambda few, mass: plan.sums(few, scratch, mass))
        return sums.withColumn("closeness", closeness_of(F.col("r"), F.col("d"), whole.ids.size, normalization or plan.normalization))
    plain = graph.canonical()
    plain = Graph(scratch.cut(plain.vertices), scratch.cut(plain.edges), plain.directed)
    few = folded(plain, scratch)
    sums = few.unfolded(plan.sums(few.graph, scratch, few.mass), scratch)
    n = plain.vertices.count()
    kind = "double" if dict(sums.dtypes)["d"] == "double" else "long"
    out = plain.vertices.join(sums, "id", "left").select("id", F.coalesce("r", F.lit(0)).cast("long").alias("r"), F.coalesce("d", F.lit(0)).cast(kind).alias("d"))
    return out.withColumn("closeness", closeness_of(F.col("r"), F.col("d"), n, normalization or plan.normalization))
