"""Reading and writing edge lists, result vectors and timing logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farness.functions import strict_double
from farness.graph import Graph


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False, directed: bool = False) -> Graph:
    """A text of a line 'n m' and m lines 'u v' (or 'u v w'), by white space; vertices are 0 to n-1.

    Raises ValueError for a bad header, a count of edges other than m, an id outside 0 to n-1 or a line that isn't numbers.
    The header is the first line of the first file.
    """
    lines = spark.read.text(path)
    head = lines.head(1)
    parts = head[0].value.split() if head else []
    if len(parts) != 2 or not all(x.isdigit() for x in parts):
        raise ValueError(f"{path}: the first line must be 'n m'")
    n, m = map(int, parts)
    # the first line of the first file alone has the place 0
    placed = lines.withColumn("_place", F.monotonically_increasing_id()).where("_place > 0")
    words = placed.select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("w")).where("size(w) > 1 OR w[0] <> ''")
    width = 3 if weighted else 2
    get = lambda k, kind: F.get("w", F.lit(k)).try_cast(kind)
    edges = words.select(get(0, "long").alias("src"), get(1, "long").alias("dst"), *([get(2, "double").alias("weight")] if weighted else []), (F.size("w") == width).alias("_whole"))
    bad = ~F.col("_whole") | F.col("src").isNull() | F.col("dst").isNull() | (F.least("src", "dst") < 0) | (F.greatest("src", "dst") >= n)
    if weighted:
        bad = bad | F.col("weight").isNull()
    found = edges.agg(F.count("*").alias("m"), F.count_if(bad).alias("bad")).first()
    if found.m != m or found.bad:
        raise ValueError(f"{path}: {found.m} edges of {m}, {found.bad} of them bad")
    return Graph(spark.range(n), edges.drop("_whole"), directed)


def write_edge_list(graph: Graph, path: str) -> None:
    """One text file: the header, then the edges in order. For exchange; large graphs are better kept as Parquet."""
    columns = ["src", "dst"] + ["weight"] * graph.weighted
    counts = graph.vertices.agg(F.count("*").alias("n")).crossJoin(graph.edges.agg(F.count("*").alias("m")))
    head = counts.select(F.lit(0).alias("k"), F.lit(None).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"), F.concat_ws(" ", "n", "m").alias("value"))
    rows = graph.edges.select(F.lit(1).alias("k"), "src", "dst", F.concat_ws(" ", *columns).alias("value"))
    head.unionByName(rows).coalesce(1).sortWithinPartitions("k", "src", "dst").select("value").write.mode("overwrite").text(path)


def write_values(results: DataFrame, path: str, plain: bool = False) -> None:
    """CSV files with a header, id and closeness in full precision, ordered by id over all files.

    plain: one text file, a number a line in the order of the ids, without a header. For exchange of small results.
    """
    if plain:
        results.select("id", F.col("closeness").cast("string").alias("value")).coalesce(1).sortWithinPartitions("id").select("value").write.mode("overwrite").text(path)
        return
    results.select("id", "closeness").orderBy("id").write.mode("overwrite").option("header", True).csv(path)


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """(place, value): the first comma-separated column of each line that is a number, in order; other lines are left out."""
    value = strict_double(F.trim(F.substring_index("value", ",", 1)))
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("place"), value.alias("value")).where("value IS NOT NULL")


def write_summary(rows: DataFrame, path: str) -> None:
    """One CSV file of a small table, with a header; the rows are ordered by all columns."""
    rows.coalesce(1).sortWithinPartitions(*rows.columns).write.mode("overwrite").option("header", True).csv(path)


def append_timing_lines(runs: DataFrame, path: str) -> None:
    """Adds lines 'method,ms' to a log of text files, without a header."""
    runs.select(F.concat_ws(",", F.col("method"), F.col("ms").cast("string")).alias("value")).coalesce(1).write.mode("append").text(path)


def read_timing_lines(spark: SparkSession, path: str) -> DataFrame:
    """(method, ms) of the lines that have a method and a number; blank and other lines are left out."""
    parts = F.split("value", ",")
    return spark.read.text(path).select(F.trim(F.get(parts, F.lit(0))).alias("method"), strict_double(F.trim(F.get(parts, F.lit(1)))).alias("ms"), F.size(parts).alias("n")).where("n = 2 AND method <> '' AND ms IS NOT NULL").drop("n")


def append_timing(spark: SparkSession, path: str, method: str, ms: float, **facts: object) -> None:
    """Adds a row (method, ms and the facts as text) to a log of Parquet files."""
    spark.createDataFrame([(method, float(ms), {k: str(v) for k, v in facts.items()})], "method string, ms double, facts map<string,string>").coalesce(1).write.mode("append").parquet(path)
