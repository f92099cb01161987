"""Query op2: rules and boosted trees over every URL of the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farness.llm.common import table
from farness.llm.url_filter import judge, train


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages, train(pages))
