"""Query op5: lines found in ten documents or more go from all of them, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farness.llm.common import table
from farness.llm.line_dedup import dedup_lines


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (SELECT doc_id, unnest(ls) line, generate_subscripts(ls, 1) p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) ls FROM documents)),
k AS (SELECT doc_id, p, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) n_lines, CAST(count(*) FILTER (hot.key IS NOT NULL) AS BIGINT) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (hot.key IS NULL), '')) kept_sha256
FROM k LEFT JOIN hot USING (key) GROUP BY doc_id
"""
