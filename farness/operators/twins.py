"""Vertices that no traversal can tell apart: twins have the same neighbours, by the same weights, in both directions.

Twins are equally far from all others, and any two of a class are equally far from each other. So two of each class are enough: the
first keeps a mass of 1 and stands for how all of them see the graph, the second has the mass of all but the first. Sums over
the folded graph count masses and are exact. Classes are found by 128 bits of hashes and then confirmed on the neighbours themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farness.graph import Graph
from farness.scratch import Scratch


@dataclass(frozen=True)
class Folded:
    """graph: two of each class at most. mass: (v, mass) of vertices that count more than once. first: (id, first) of all twins."""

    vertices: DataFrame
    graph: Graph
    mass: DataFrame | None
    first: DataFrame | None

    def unfolded(self, sums: DataFrame, scratch: Scratch) -> DataFrame:
        """(id, r, d) of all vertices from those of the folded graph: twins have the sums of their first."""
        if self.first is None:
            return sums
        sums = scratch.cut(sums.select(F.col("id").alias("first"), "r", "d"))
        return self.vertices.join(self.first, "id", "left").withColumn("first", F.coalesce("first", "id")).join(sums, "first").select("id", "r", "d")


def folded(graph: Graph, scratch: Scratch) -> Folded:
    """A canonical graph without the third and further of its twins."""
    weight = ["weight"] * graph.weighted
    out = graph.edges.select(F.col("src").alias("id"), F.lit(False).alias("back"), F.col("dst").alias("near"), *weight)
    near = out.unionByName(graph.edges.select(F.col("dst").alias("id"), F.lit(graph.directed).alias("back"), F.col("src").alias("near"), *weight))
    marks = ["k", "one", "two"]
    hashes = (F.bit_xor(F.xxhash64(F.lit(k), "back", "near", *weight)) for k in (1, 2))
    marked = scratch.cut(near.groupBy("id").agg(F.count("*").alias("k"), *[h.alias(name) for h, name in zip(hashes, marks[1:], strict=True)]))
    classes = marked.groupBy(*marks).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 2")
    alike = scratch.cut(marked.join(scratch.cut(classes), marks).select("id", "first", "n"))
    if alike.isEmpty():
        return Folded(graph.vertices, graph, None, None)
    # each neighbour of a class is one of all its members
    odd = near.join(alike, "id").groupBy("first", "n", "back", "near", *weight).agg(F.count("*").alias("have")).where("have <> n").select("first").distinct()
    alike = alike.join(scratch.cut(odd), "first", "left_anti")
    seconds = scratch.cut(alike.where("id <> first").groupBy("first").agg(F.min("id").alias("v"), F.count("*").alias("mass")))
    gone = scratch.cut(alike.join(seconds.select(F.col("v").alias("id")), "id", "left_anti").where("id <> first").select("id"))
    kept = graph.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    small = Graph(scratch.cut(graph.vertices.join(gone, "id", "left_anti")), scratch.cut(kept.select("src", "dst", *weight)), graph.directed)
    return Folded(graph.vertices, small, seconds.select("v", "mass"), scratch.cut(alike.select("id", "first")))
