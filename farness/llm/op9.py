"""Query op9: near-duplicates of all documents at 85 hundredths, linked exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farness.llm.common import table
from farness.llm.near_duplicates import near_duplicates


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept", "class_id")
