"""Query op7: base counts and the verdict of line-first cleaning, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farness.llm.common import table
from farness.llm.quality_rules import BOILERPLATE, NAVIGATION, STOPS, SYMBOLS, LineRules, line_first

RETURNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_failed", "kept_chars")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_first(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*RETURNS)


R = LineRules()
_seps = " + ".join(f"(length(l) - length(replace(l, '{s}', ''))) / {len(s)}" for s in NAVIGATION)
_furniture = " OR ".join(f"contains(lower(l), '{x}')" for x in BOILERPLATE)
_fails = f"""(length(l) - length(regexp_replace(l, '[{SYMBOLS}]', '', 'g')) > {R.max_symbols} * length(l)
  OR (length(l) >= {R.upper_from} AND length(l) - length(regexp_replace(l, '[A-ZÀ-ÖØ-Þ]', '', 'g')) > {R.max_upper} * length(l))
  OR (length(l) - length(replace(l, '!', '')) >= {R.shouts_from} AND length(l) - length(replace(l, '!', '')) > {R.max_shouts} * length(l))
  OR {_seps} >= {R.nav_from}
  OR (length(l) - length(replace(l, ' ', '')) >= {R.unstopped_words} AND length(l) = length(regexp_replace(l, '[{STOPS}]', '', 'g')))
  OR {_furniture})"""
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws, string_split(t, chr(10)) ls FROM d),
g AS (SELECT doc_id, i, struct_pack(a := ws[i], b := ws[i + 1], c := ws[i + 2]) g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) i FROM w)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) p FROM f) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(ls) l FROM w),
lines AS (SELECT doc_id, count(*) FILTER (bad) n_failed, coalesce(sum(length(l)) FILTER (NOT bad), 0) kept_chars, sum(length(l)) all_chars,
            count(*) FILTER (has) - count(DISTINCT l) FILTER (has) dup
          FROM (SELECT doc_id, l, {_fails} bad, regexp_matches(l, '[^\x20\x09-\x0D]') has FROM line) GROUP BY doc_id),
a AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) word_chars,
        CAST(length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS BIGINT) n_symbols, CAST(dup AS BIGINT) n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) n_repeat_words, CAST(n_failed AS BIGINT) n_lines_failed, CAST(kept_chars AS BIGINT) kept_chars, all_chars
      FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND kept_chars >= {R.min_kept} * all_chars kept, n_lines_failed, kept_chars FROM b
"""
