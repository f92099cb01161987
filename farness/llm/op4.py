"""Query op4: the language of every document, learned outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farness.llm.common import in_fold, table
from farness.llm.languages import predict, train


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = in_fold(F.col("doc_id"), 4, 2)
    model = train(docs.where(~held_out).select("doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", "text"), model, spans=False)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
