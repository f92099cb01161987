"""A corpus from raw documents to packed token sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) of all that the stage before it kept; its result is written as Parquet and read again.
All but the last return the columns of documents, with n_chars brought up to date where the text changed. Rows are dropped, not ids: a row
that shares its id with one that goes stays unless its own text is against it. Rows without an id are judged by their text, but are
linked with nothing by near-dedup; an empty table passes all stages. The first stage lets the session's Arrow batches be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farness.llm.common import BLANKS, small_batches, spare, table
from farness.llm.decontamination import decontaminated
from farness.llm.line_dedup import dedup_lines
from farness.llm.near_duplicates import without_near_duplicates
from farness.llm.op6 import vocabulary
from farness.llm.packing import pack_documents
from farness.llm.quality_rules import line_first
from farness.scratch import Scratch


def _with_text(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The given columns of df, the text replaced by another column and n_chars by its length."""
    new = {"text": F.col(f"`{text}`"), "n_chars": F.length(F.col(f"`{text}`")).cast("long")}
    return df.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go; documents that fail the base rules or lose too much go."""
    small_batches(spark)  # for this stage and the Arrow passes of those after it
    kept, clean = spare(docs, "kept", "clean_text")
    return _with_text(line_first(docs).where(F.col(kept)), docs.columns, clean)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay in the first of them only; documents of which no text is left go."""
    dropped, text = spare(docs, "n_dropped", "kept_text")
    out = dedup_lines(docs, keep="first")
    return _with_text(out.where((F.col(dropped) == 0) | (F.length(F.btrim(text, F.lit(BLANKS))) > 0)), docs.columns, text)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked at a similarity of 0.8 on five-word shingles, one of the least id stays."""
    return without_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 token ids, with the ids."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Tokenization and estimated candidates aren't for SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
