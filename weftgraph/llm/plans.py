"""Queries of this subpackage."""

from __future__ import annotations

from ..plans.registry import Query, Registry
from ..sources.tables import table
from . import docpairs, handwritten, leaks, mixing, repetition, syntax

R = Registry()


def _code_tables(spark, d):
    return (
        table(spark, d, "nodes", "id", "label", "file_type", "source_file", "source_line", "docstring", "loaded_at"),
        table(spark, d, "file_contents", "file_path", "content"),
    )


@R.query("p1_found")
def p1_found(spark, d):
    return docpairs.documented_ids(*_code_tables(spark, d))


@R.query("p1_pairs")
def p1_pairs(spark, d):
    return docpairs.pairs(*_code_tables(spark, d))


def _file_tables(spark, d):
    return table(spark, d, "file_contents", "file_path", "content"), table(spark, d, "file_manifest", "file_path", "file_type", "repo")


@R.query("p4_found")
def p4_found(spark, d):
    return handwritten.not_handwritten(*_file_tables(spark, d)).select("file_path")


@R.query("p4_kinds")
def p4_kinds(spark, d):
    return handwritten.not_handwritten(*_file_tables(spark, d))


@R.query("p4_measures")
def p4_measures(spark, d):
    return handwritten.measured(_file_tables(spark, d)[0]).drop("print").distinct()


@R.query("p5_found")
def p5_found(spark, d):
    return syntax.invalid_files(*_file_tables(spark, d)).select("file_path")


@R.query("p5_errors")
def p5_errors(spark, d):
    return syntax.invalid_files(*_file_tables(spark, d))


@R.query("p5_rates")
def p5_rates(spark, d):
    return syntax.rates(*_file_tables(spark, d))


def _leaks(spark, d):
    return leaks.leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "suite", "text"))


@R.query("p7_found")
def p7_found(spark, d):
    return _leaks(spark, d)


@R.query("p7_items")
def p7_items(spark, d):
    return leaks.report(_leaks(spark, d), table(spark, d, "eval_items", "item_id", "suite"))


def _mix(spark, d):
    return mixing.mix(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"))


@R.query("p8_mix")
def p8_mix(spark, d):
    return _mix(spark, d).documents


@R.query("p8_shares")
def p8_shares(spark, d):
    return _mix(spark, d).report


_P9 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\p{L}+') ws FROM documents),
  x AS (SELECT doc_id, unnest(ws) wd, generate_subscripts(ws, 1) i FROM w),
  g AS (SELECT doc_id, i, CASE WHEN lead(wd, 4) OVER o IS NOT NULL THEN
      concat_ws(' ', wd, lead(wd, 1) OVER o, lead(wd, 2) OVER o, lead(wd, 3) OVER o, lead(wd, 4) OVER o) END k
    FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  r AS (SELECT doc_id, i, k IS NOT NULL AND i > min(i) OVER (PARTITION BY doc_id, k) rep FROM g),
  c AS (SELECT doc_id, bool_or(rep) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) hit FROM r),
  s AS (SELECT w.doc_id, len(ws) n_words, count(*) FILTER (hit) n_repeated FROM w LEFT JOIN c USING (doc_id) GROUP BY ALL)
"""


@R.query("p9_found", _P9 + "SELECT doc_id FROM s WHERE n_words >= 5 AND n_repeated >= 0.3 * n_words")
def p9_found(spark, d):
    return repetition.repetitive(table(spark, d, "documents", "doc_id", "text")).select("doc_id")


@R.query(
    "p9_shares",
    _P9 + "SELECT doc_id, n_words, n_repeated, coalesce(round(n_repeated::DOUBLE / nullif(n_words, 0), 6), 0) AS repeated_share FROM s",
)
def p9_shares(spark, d):
    return repetition.shares(table(spark, d, "documents", "doc_id", "text"))


@R.query("p9_bands")
def p9_bands(spark, d):
    return repetition.bands(table(spark, d, "documents", "doc_id", "text"))


def queries() -> dict[str, Query]:
    return dict(R.queries)


def oracle_sql() -> dict[str, str]:
    return dict(R.sql)
