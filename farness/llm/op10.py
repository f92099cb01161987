"""Query op10: token ids written as ORC files and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farness.llm.common import table
from farness.llm.op6 import vocabulary
from farness.llm.token_files import token_digests, write_token_files
from farness.scratch import Scratch


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-files").path("orc")
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return token_digests(spark, path)
