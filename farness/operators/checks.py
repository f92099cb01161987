"""Graph reports, edge probes, and comparisons of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farness.graph import Graph
from farness.operators.components import connected_components
from farness.scratch import Scratch


def degrees(graph: Graph) -> DataFrame:
    """(id, degree) for every vertex; 0 for isolated ones."""
    return graph.vertices.join(graph.arcs().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def graph_report(graph: Graph, scratch: Scratch) -> DataFrame:
    """One row: n, m, unique_edges, self_loops, duplicates and components (0 for a graph without vertices), of the edges as they are."""
    pair = F.struct(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    counted = graph.edges.agg(F.count("*").alias("m"), F.count_distinct(pair).alias("unique_edges"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))
    joined = connected_components(graph.edges, scratch)
    comps = graph.vertices.join(joined, "id", "left").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("component", "id")).alias("components"))
    return counted.crossJoin(comps).select("n", "m", "unique_edges", "self_loops", (F.col("m") - F.col("unique_edges")).alias("duplicates"), "components")


def edges_present(graph: Graph, probes: DataFrame) -> DataFrame:
    """probes (src, dst) plus present: whether the graph has the edge, in either direction if undirected."""
    known = graph.arcs().select("src", "dst").distinct().withColumn("present", F.lit(True))
    return probes.join(known, ["src", "dst"], "left").select("src", "dst", F.coalesce("present", F.lit(False)).alias("present"))


def top_k(results: DataFrame, k: int = 10, by: str = "closeness") -> DataFrame:
    """The k rows of the greatest value; of equal ones, the least ids."""
    return results.orderBy(F.col(by).desc(), F.col("id")).limit(k)


def method_mse(results: DataFrame) -> DataFrame:
    """(method_i, method_j, mse) for every two methods of (method, id, closeness), aligned by id; null where no id is shared."""
    names = results.select("method").distinct()
    pairs = names.select(F.col("method").alias("method_i")).join(names.select(F.col("method").alias("method_j")), F.col("method_i") < F.col("method_j"))
    left = results.select(F.col("method").alias("method_i"), "id", F.col("closeness").alias("ci"))
    right = results.select(F.col("method").alias("method_j"), "id", F.col("closeness").alias("cj"))
    errors = left.join(right, "id").where("method_i < method_j").groupBy("method_i", "method_j").agg(F.avg((F.col("ci") - F.col("cj")) * (F.col("ci") - F.col("cj"))).alias("mse"))
    return pairs.join(errors, ["method_i", "method_j"], "left")


def max_abs_error(a: DataFrame, b: DataFrame, bound: float = 1e-4) -> DataFrame:
    """One row: rows compared, the greatest difference of closeness, and whether it is under the bound."""
    both = a.select("id", F.col("closeness").alias("x")).join(b.select("id", F.col("closeness").alias("y")), "id")
    return both.agg(F.count("*").alias("compared"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_error")).withColumn("passed", F.coalesce(F.col("max_error") < bound, F.lit(False)))


def run_stats(runs: DataFrame, by: list[str], ms: Column | str = "ms") -> DataFrame:
    """Mean, least and greatest time of runs by the given columns."""
    return runs.groupBy(*by).agg(F.avg(ms).alias("mean_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.count("*").alias("runs"))


def speedups(stats: DataFrame, by: list[str], baseline: str) -> DataFrame:
    """stats (method, mean_ms, the columns of by) plus speedup: the baseline's mean over the method's."""
    base = stats.where(F.col("method") == baseline).select(*by, F.col("mean_ms").alias("_base"))
    return stats.join(base, by).withColumn("speedup", F.col("_base") / F.col("mean_ms")).drop("_base")
