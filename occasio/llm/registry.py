"""The subpackage's queries and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, tuple[str, str]] = {
    "op1_ngram_jaccard_join": ("ngramjoin", "op1_ngram_jaccard_join"),
    "op2_best_fit_packing": ("packing", "op2_best_fit_packing"),
    "op3_toxicity": ("toxicity", "op3_toxicity"),
    "op4_lm_scoring": ("kneser", "op4_lm_scoring"),
    "op5_benchmark_decontamination": ("decontam", "op5_benchmark_decontamination"),
    "op6_html_extraction": ("html", "op6_html_extraction"),
    "op7_quality": ("quality", "op7_quality"),
    "op8_media_columns": ("media", "op8_media_columns"),
    "op9_pii": ("pii", "op9_pii"),
    "op10_line_dedup": ("linededup", "op10_line_dedup"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), f) for name, (module, f) in QUERIES.items()}


#: The groups by brute force: all pairs that share a shingle, and everything reachable over links.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, GREATEST(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), x AS (SELECT doc_id, len(s) AS n, UNNEST(s) AS g FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * COUNT(*) >= 80 * (a.n + b.n - COUNT(*))
), reach AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT doc_id, MIN(r) AS component_id FROM reach GROUP BY 1) m USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
