"""Breadth-first and weighted traversals, all sources in the same loop.

Up to LOCAL_ARCS arcs, as counted, sums are made by tasks that know the whole graph (local.py). Beyond that each level is one join of
the frontier with the arcs and one aggregation with partial sums before the shuffle; only the frontier is shuffled and written, a
level's table in the shared folder goes once no later level looks at it. The driver only asks whether the frontier is empty.
Both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farness.operators.local import LOCAL_ARCS, local_sums, local_weighted_sums
from farness.scratch import Scratch


def bfs_pairs(arcs: DataFrame, sources: DataFrame, scratch: Scratch, symmetric: bool = False) -> DataFrame:
    """(source, v, d): the hop distance of every vertex reached from every source (column id), the source itself at 0.

    symmetric says that every arc has its reverse: then a level can only meet the two before it again.
    """
    frontier = scratch.cut(sources.select(F.col("id").alias("source"), F.col("id").alias("v")).distinct())
    levels, reached, level = [frontier], frontier.withColumn("d", F.lit(0)), 0
    while not frontier.isEmpty():
        level += 1
        step = frontier.join(arcs, frontier["v"] == arcs["src"]).select("source", F.col("dst").alias("v")).distinct()
        for before in levels[-2:] if symmetric else [reached]:
            step = step.join(before.select("source", "v"), ["source", "v"], "left_anti")
        frontier = scratch.cut(step)
        levels.append(frontier)
        reached = reached.unionByName(frontier.withColumn("d", F.lit(level)))
    return reached


def msbfs_sums(arcs: DataFrame, vertices: DataFrame, scratch: Scratch, symmetric: bool = False, local_arcs: int = LOCAL_ARCS, mass: DataFrame | None = None) -> DataFrame:
    """(id, r, d) for every vertex: how many others reach it along the arcs, and the sum of their hop distances.

    mass (v, mass) names the vertices that count more than once.

    64 sources share a BIGINT: a bit of (batch, v) says that the source has reached v. For distances out of v give reversed
    arcs. Batches are ranges of a table's rows, so no global ranking is needed.
    """
    if arcs.count() <= local_arcs:
        return local_sums(arcs, vertices, scratch, mass)
    ranked = scratch.cut(vertices.select("id", F.monotonically_increasing_id().alias("place")))
    name = lambda kind, level: f"{kind}-{tag}-{level}"
    tag = scratch.n
    bit = F.expr("shiftleft(1L, CAST(pmod(place, 64) AS INT))")
    frontier = scratch.keep(ranked.select(F.shiftright("place", 6).alias("batch"), F.col("id").alias("v"), bit.alias("bits")), name("bits", 0))
    levels, sums, level, zero = [frontier], None, 0, F.lit(0).cast("long")
    counted, planes = F.bit_count("bits").cast("long"), None
    if mass is not None:
        # the sources of a batch whose mass, less 1, has a bit
        marks = ranked.join(mass.withColumnRenamed("v", "id"), "id").select(F.shiftright("place", 6).alias("batch"), bit.alias("mark"), "mass", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("k"))
        marks = marks.where("(shiftright(mass - 1, k) & 1) = 1").groupBy("batch", "k").agg(F.bit_or("mark").alias("mark"))
        planes = scratch.cut(marks.groupBy("batch").agg(F.collect_list(F.struct("k", "mark")).alias("planes")))
        counted = F.expr("bit_count(bits) + aggregate(coalesce(planes, array()), 0L, (n, p) -> n + shiftleft(CAST(bit_count(bits & p.mark) AS BIGINT), p.k))")
    while not frontier.isEmpty():
        level += 1
        onward = frontier.join(arcs, frontier["v"] == arcs["src"]).select("batch", F.col("dst").alias("v"), F.col("bits").alias("next"), zero.alias("had"))
        for before in levels[-2:] if symmetric else levels:
            # rows of the past count only where something new arrives
            onward = onward.unionByName(before.select("batch", "v", zero.alias("next"), F.col("bits").alias("had")))
        met = onward.groupBy("batch", "v").agg(F.bit_or("next").alias("next"), F.bit_or("had").alias("had"))
        new = met.select("batch", "v", F.col("next").bitwiseAND(F.bitwise_not("had")).alias("bits")).where("bits <> 0")
        frontier = scratch.keep(new, name("bits", level))
        levels.append(frontier)
        weighed = frontier if planes is None else frontier.join(planes, "batch", "left")
        gained = weighed.groupBy(F.col("v").alias("id")).agg(F.sum(counted).alias("r")).select("id", "r", (F.col("r") * level).alias("d"))
        sums = scratch.keep(gained if sums is None else sums.unionByName(gained).groupBy("id").agg(F.sum("r").alias("r"), F.sum("d").alias("d")), name("sums", level))
        if level > 1:
            scratch.drop(name("sums", level - 1))
            if symmetric:
                scratch.drop(name("bits", level - 2))
    out = ranked.select("id") if sums is None else ranked.join(sums, "id", "left")
    return out.select("id", *[(F.coalesce(c, zero) if sums is not None else zero).alias(c) for c in ("r", "d")])


def least_sums(arcs: DataFrame, vertices: DataFrame, scratch: Scratch, local_arcs: int = LOCAL_ARCS, mass: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(id, r, d): how many others a vertex reaches along weighted arcs and the sum of its least distances to them.

    mass (v, mass) names the vertices that count more than once; sources (id) those that are asked for, all if not given.
    """
    if arcs.count() <= local_arcs:
        return local_weighted_sums(arcs, vertices, scratch, mass, sources)
    return pair_sums(shortest_paths(arcs, vertices if sources is None else sources, scratch), mass)


def shortest_paths(arcs: DataFrame, sources: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, v, d): the least sum of weights from every source to every vertex it reaches, the source itself at 0.

    Only vertices whose distance fell go on, until none falls; weights must not be negative.
    """
    kind = dict(arcs.dtypes)["weight"]
    zero = F.lit(0).cast(kind)
    state = scratch.cut(sources.select(F.col("id").alias("source"), F.col("id").alias("v"), zero.alias("d"), F.lit(True).alias("fell")).distinct())
    while not (live := state.where("fell")).isEmpty():
        onward = live.join(arcs, live["v"] == arcs["src"]).select("source", F.col("dst").alias("v"), (F.col("d") + F.col("weight")).alias("d"), F.lit(None).cast(kind).alias("old"))
        both = state.select("source", "v", "d", F.col("d").alias("old")).unionByName(onward)
        merged = both.groupBy("source", "v").agg(F.min("d").alias("d"), F.min("old").alias("old"))
        state = scratch.cut(merged.select("source", "v", "d", (F.col("old").isNull() | (F.col("d") < F.col("old"))).alias("fell")))
    return state.select("source", "v", "d")


def pair_sums(pairs: DataFrame, mass: DataFrame | None = None) -> DataFrame:
    """(id, r, d) of each source from (source, v, d); mass (v, mass) names the vertices that count more than once."""
    if mass is not None:
        n = F.coalesce("mass", F.lit(1).cast("long"))
        other = F.when(F.col("source") != F.col("v"), n).otherwise(0)
        return pairs.join(mass, "v", "left").groupBy(F.col("source").alias("id")).agg(F.sum(other).alias("r"), F.sum(n * F.col("d")).alias("d"))
    return pairs.groupBy(F.col("source").alias("id")).agg((F.count("*") - 1).alias("r"), F.sum("d").alias("d"))
