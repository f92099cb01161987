"""Query op8: licences of every document by identifier sequences, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farness.llm.common import table
from farness.llm.licenses import CATEGORIES, HOLDER, LINE_END, OPEN_NAME, PARAGRAPH, RULES, SENTENCE_END, SENTENCES, SPDX, SPDX_TAG, scan_licences


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "line_ids", "paragraph_ids", "licences", "category")


def _taken(column: str) -> list[str]:
    """SQL for the sequence before each rule."""
    out = [column]
    for _, _, pattern in RULES:
        out.append(f"regexp_replace({out[-1]}, '{pattern}', '', 'g')")
    return out


_names = ", ".join(f"('{k}', ' {v} ')" for k, v in SENTENCES.items())
_spdx = ", ".join(f"('{k}', ' {v} ')" for k, v in SPDX.items())
_seq = lambda name: f"""{name} AS (SELECT doc_id, string_agg(id, '' ORDER BY p, q) s FROM (
  SELECT s.doc_id, p, 0 q, names.id FROM {name}_cut s JOIN names USING (x)
  UNION ALL SELECT e.doc_id, p, q, spdx.id FROM (
    SELECT doc_id, p, unnest(ns) n, generate_subscripts(ns, 1) q FROM (
      SELECT doc_id, p, regexp_split_to_array(replace(CASE WHEN starts_with(x, '{SPDX_TAG} ') THEN substr(x, {len(SPDX_TAG) + 2}) ELSE x END, ' or later', ' plus'), ' (?:or|and|with) ') ns
      FROM {name}_cut WHERE (before = '{SPDX_TAG}' OR starts_with(x, '{SPDX_TAG} ')) AND x NOT IN (SELECT x FROM names))) e JOIN spdx ON spdx.x = e.n) GROUP BY doc_id)"""  # noqa: E731
_cut = lambda t, name: f"""{name}_cut AS (SELECT doc_id, p, x, lag(x) OVER (PARTITION BY doc_id ORDER BY p) before FROM (
  SELECT doc_id, p, regexp_replace(trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')), '{OPEN_NAME}', '{HOLDER}') x FROM (
    SELECT doc_id, unnest(xs) x, generate_subscripts(xs, 1) p FROM (SELECT doc_id, regexp_split_to_array({t}, '{SENTENCE_END}') xs FROM d))) WHERE x <> '')"""  # noqa: E731
_marks = ", ".join(f"CASE WHEN regexp_matches({a}, '{r[2]}') OR regexp_matches({b}, '{r[2]}') THEN '{r[0]}:{r[1]}' END" for r, a, b in zip(RULES, _taken("ls"), _taken("ps"), strict=False))
_first = " ".join(f"WHEN len(list_filter(m, lambda x: ends_with(x, ':{c}'))) > 0 THEN '{c}'" for c in CATEGORIES)
OP8_SQL = rf"""
WITH d AS (SELECT doc_id, lower(coalesce(text, '')) t FROM documents),
names(x, id) AS (VALUES {_names}),
spdx(x, id) AS (VALUES {_spdx}),
{_cut("t", "l")}, {_seq("l")},
{_cut(f"regexp_replace(regexp_replace(t, '{PARAGRAPH}', '. ', 'g'), '{LINE_END}', ' ', 'g')", "p")}, {_seq("p")},
s AS (SELECT d.doc_id, coalesce(l.s, '') ls, coalesce(p.s, '') ps FROM d LEFT JOIN l USING (doc_id) LEFT JOIN p USING (doc_id)),
m AS (SELECT doc_id, ls, ps, list_filter([{_marks}], lambda x: x IS NOT NULL) m FROM s),
v AS (SELECT doc_id, ls, ps, list_filter(m, lambda x, i: list_position(m, x) = i) m FROM m),
u AS (SELECT doc_id, ls, ps, list_filter(m, lambda x: len(m) = 1 OR x <> 'unnamed:other') m FROM v)
SELECT doc_id, trim(replace(ls, '  ', ',')) line_ids, trim(replace(ps, '  ', ',')) paragraph_ids,
  coalesce(array_to_string(list_transform(m, lambda x: split_part(x, ':', 1)), ','), '') licences, CASE {_first} ELSE 'none' END category FROM u
"""
