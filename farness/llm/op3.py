"""Query op3: which documents hold which benchmark items, substitutions tolerated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farness.llm.common import table
from farness.llm.decontamination import contaminated


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
