"""Seeded graph generators. The same arguments give the same graph; exact counts come from ranking distinct candidates by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farness.graph import Graph


def _draw(seed: int, *keys: Column | str) -> Column:
    """A number that the seed and the keys give, not negative."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 62))


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]


def _distinct_pairs(spark: SparkSession, n: int, m: int, seed: int, known: DataFrame | None = None) -> DataFrame:
    """m distinct pairs src < dst of 0..n-1, none of them known: candidates are drawn in excess until there are enough."""
    if m > n * (n - 1) // 2 - (known.count() if known is not None else 0):
        raise ValueError("more edges than a simple graph has room for")
    dense = 4 * m > n * (n - 1) // 2
    if dense:
        place = spark.range(n * n)
        pairs = place.select((F.col("id") % n).alias("src"), F.floor(F.col("id") / n).cast("long").alias("dst")).where("src < dst")
        chosen = pairs if known is None else pairs.join(known, ["src", "dst"], "left_anti")
        return chosen.orderBy(_draw(seed, "src", "dst"), "src", "dst").limit(m)
    drawn = 2 * m + 16
    while True:
        cells = spark.range(drawn).select("id", (_draw(seed, F.lit(1), "id") % n).alias("a"), (_draw(seed, F.lit(2), "id") % n).alias("b"))
        pairs = cells.where("a <> b").select(*_pair(F.col("a"), F.col("b"))).distinct()
        pairs = pairs if known is None else pairs.join(known, ["src", "dst"], "left_anti")
        if pairs.count() >= m:
            return pairs.orderBy(_draw(seed, "src", "dst"), "src", "dst").limit(m)
        drawn *= 2


def connected(spark: SparkSession, n: int, m: int, seed: int = 42) -> Graph:
    """A random recursive tree and further random edges, m in all; m must be n-1 at least."""
    if m < n - 1:
        raise ValueError("a connected graph needs n-1 edges at least")
    tree = spark.range(1, n).select((_draw(seed, "id") % F.col("id")).alias("src"), F.col("id").alias("dst"))
    return Graph(spark.range(n), tree.unionByName(_distinct_pairs(spark, n, m - (n - 1), seed + 1, tree)) if m > n - 1 else tree)


def uniform(spark: SparkSession, n: int, m: int, seed: int = 42) -> Graph:
    """m distinct edges; connected or not."""
    return Graph(spark.range(n), _distinct_pairs(spark, n, m, seed))


def blocks_in_a_row(spark: SparkSession, n: int, m: int, seed: int = 42, blocks: int | None = None, distinct: bool = True) -> Graph:
    """Cycles of consecutive ids, each joined to the next by a bridge, and further edges inside cycles: m in all, those at least.

    2k-1 biconnected blocks and 2(k-1) articulation vertices for k cycles of three vertices or more (n/2000, two at least, by
    default). distinct=False draws the further edges as they come, so that some repeat others. Raises ValueError if distinct edges
    don't find room.
    """
    k = blocks or max(2, n // 2000)
    size = n // k
    if size < 3:
        raise ValueError("cycles need three vertices at least")
    last = n - (k - 1) * size
    extra = max(0, m - n - (k - 1))
    if distinct and extra > (k - 1) * (size * (size - 3) // 2) + last * (last - 3) // 2:
        raise ValueError("more edges than the cycles have room for")
    block = F.least(F.floor(F.col("id") / size), F.lit(k - 1)).cast("long")
    start = block * size
    own = F.when(block == k - 1, F.lit(last)).otherwise(F.lit(size))
    ring = spark.range(n).select(*_pair(F.col("id"), start + (F.col("id") - start + 1) % own))
    bridges = spark.range(k - 1).select(((F.col("id") + 1) * size - 1).alias("src"), ((F.col("id") + 1) * size).alias("dst"))
    base, drawn = ring.unionByName(bridges), extra if not distinct else 2 * extra + 16
    while True:
        cells = spark.range(drawn).select((_draw(seed, F.lit(1), "id") % n).alias("id"), F.col("id").alias("j"))
        # another vertex of the same cycle
        cells = cells.select(*_pair(F.col("id"), start + (F.col("id") - start + 1 + _draw(seed, F.lit(2), "j") % (own - 1)) % own))
        if not distinct:
            return Graph(spark.range(n), base.unionByName(cells))
        cells = cells.distinct().join(ring, ["src", "dst"], "left_anti")
        if cells.count() >= extra:
            return Graph(spark.range(n), base.unionByName(cells.orderBy(_draw(seed, "src", "dst"), "src", "dst").limit(extra)))
        drawn *= 2


def chain_of_cliques(spark: SparkSession, cliques: int = 8, size: int = 6) -> Graph:
    """Directed cliques of weights 1 + (i + j) mod 3, each joined to the next by one arc of weight 2."""
    cells = spark.range(cliques * size * size).select(F.floor(F.col("id") / (size * size)).cast("long").alias("c"), F.floor(F.col("id") / size % size).cast("long").alias("i"), (F.col("id") % size).alias("j"))
    inside = cells.where("i <> j").select((F.col("c") * size + F.col("i")).alias("src"), (F.col("c") * size + F.col("j")).alias("dst"), (1 + (F.col("i") + F.col("j")) % 3).cast("double").alias("weight"))
    onward = spark.range(cliques - 1).select(((F.col("id") + 1) * size - 1).alias("src"), ((F.col("id") + 1) * size).alias("dst"), F.lit(2.0).alias("weight"))
    return Graph(spark.range(cliques * size), inside.unionByName(onward), True)


def random_directed(spark: SparkSession, n: int, p: float, seed: int = 77) -> Graph:
    """Each arc with probability p, weights 1 + half of 0 to 9."""
    cells = spark.range(n * n).select((F.col("id") % n).alias("src"), F.floor(F.col("id") / n).cast("long").alias("dst"))
    edges = cells.where("src <> dst").where(_draw(seed, "src", "dst") < int(p * (1 << 62)))
    return Graph(spark.range(n), edges.withColumn("weight", 1 + 0.5 * (_draw(seed + 1, "src", "dst") % 10)), True)


def insert_batch(graph: Graph, count: int, seed: int = 123) -> DataFrame:
    """Updates that insert `count` edges which the graph (of vertices 0..n-1) doesn't have; weights 1 if it is weighted."""
    spark, n = graph.vertices.sparkSession, graph.vertices.count()
    known = graph.edges.select(*_pair(F.col("src"), F.col("dst"))).distinct()
    new = _distinct_pairs(spark, n, count, seed, known)
    return new.select(F.lit("insert").alias("op"), "src", "dst", *([F.lit(1.0).alias("weight")] if graph.weighted else []))
