"""Vertices whose traversal can be left out: those of degree 3 or 4 with a tight neighbourhood.

r3: three neighbours that all touch each other. r4: four neighbours that form a cycle without chords.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farness.graph import Graph
from farness.operators.biconnected import articulation_points
from farness.operators.traverse import bfs_pairs, pair_sums
from farness.scratch import Scratch


def redundant_vertices(graph: Graph) -> DataFrame:
    """(id, kind) of a canonical undirected graph, kind being 'r3' or 'r4'. Only neighbour lists of degree 3 and 4 are joined."""
    arcs = graph.arcs()
    degree = arcs.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("k")).where("k IN (3, 4)")
    near = arcs.select(F.col("src").alias("v"), F.col("dst").alias("u")).join(degree, "v")
    pairs = near.join(near.select("v", F.col("u").alias("w")), "v").where("u < w")
    touching = pairs.join(graph.edges.select(F.col("src").alias("u"), F.col("dst").alias("w")), ["u", "w"], "left_semi")
    ends = touching.select("v", "k", F.explode(F.array("u", "w")).alias("u")).groupBy("v", "k", "u").agg(F.count("*").alias("touched"))
    shape = ends.groupBy("v", "k").agg(F.count("*").alias("n"), F.min("touched").alias("lo"), F.max("touched").alias("hi"))
    kind = F.when((F.col("k") == 3) & (F.col("n") == 3) & (F.col("lo") == 2), "r3").when((F.col("k") == 4) & (F.col("n") == 4) & (F.col("lo") == 2) & (F.col("hi") == 2), "r4")
    return shape.select(F.col("v").alias("id"), kind.alias("kind")).where("kind IS NOT NULL")


def reduction_stats(graph: Graph, members: DataFrame) -> DataFrame:
    """One row: blocks, articulations, r3, r4 and the share of redundant vertices; members are the blocks' (block_members())."""
    kinds = redundant_vertices(graph).agg(F.count_if(F.col("kind") == "r3").alias("r3"), F.count_if(F.col("kind") == "r4").alias("r4"))
    counts = members.select("block_a", "block_b").distinct().agg(F.count("*").alias("blocks")).crossJoin(articulation_points(members).agg(F.count("*").alias("articulations")))
    n = graph.vertices.agg(F.count("*").alias("n"))
    share = F.when(F.col("n") > 0, (F.col("r3") + F.col("r4")) / F.col("n").cast("double")).otherwise(F.lit(0.0))
    return counts.crossJoin(kinds).crossJoin(n).select("blocks", "articulations", "r3", "r4", share.alias("redundant_share"))


def reduced_sums(graph: Graph, scratch: Scratch, mass: DataFrame | None = None) -> DataFrame:
    """(id, r, d): traversals start at the vertices that aren't redundant; the redundant take the distances backwards.

    Distances between redundant vertices come from the ends of their edges: the least over two neighbours plus 2, or 1 if they touch,
    with neighbours that are redundant themselves traversed as well, so that every distance is exact.
    """
    arcs = scratch.cut(graph.arcs())
    marked = scratch.cut(redundant_vertices(graph).select("id"))
    # a redundant vertex with a redundant neighbour stays a source
    twins = arcs.join(marked.withColumnRenamed("id", "src"), "src", "left_semi").join(marked.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    skipped = scratch.cut(marked.join(twins, "id", "left_anti"))
    sources = graph.vertices.join(skipped, "id", "left_anti")
    pairs = scratch.cut(bfs_pairs(arcs, sources, scratch, True))
    back = pairs.join(skipped.withColumnRenamed("id", "v"), "v", "left_semi").select(F.col("v").alias("source"), F.col("source").alias("v"), "d")
    own = skipped.join(arcs, skipped["id"] == arcs["src"]).select("id", F.col("dst").alias("source"))
    # a skipped vertex's neighbours are sources: its distance to another skipped one is the least of theirs plus 1
    across = own.join(pairs.join(skipped.withColumnRenamed("id", "v"), "v", "left_semi"), "source").where("v <> id")
    across = across.groupBy(F.col("id").alias("source"), "v").agg((F.min("d") + 1).alias("d"))
    every = pairs.where("source <> v").unionByName(back).unionByName(across)
    if mass is not None:
        return pair_sums(every, mass)
    return every.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("r"), F.sum("d").alias("d"))
