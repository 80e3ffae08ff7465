"""Queries of problem 1: references to judgments that were not held at the time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.operators.orphans import Reference, orphan_report, orphan_rows
from lexmill.session import load


def _parts(spark: SparkSession, sf_dir: str):
    refs = {
        "resolutions": Reference(load(spark, sf_dir, "resolutions"), "mention_id", "doc_id", "resolved_at"),
        "evidence": Reference(load(spark, sf_dir, "evidence"), "evidence_id", "citing_doc", "recorded_at"),
    }
    return refs, load(spark, sf_dir, "judgments").select("doc_id", "ingested_at", "removed_at")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, parents = _parts(spark, sf_dir)
    return orphan_rows(refs, parents, "doc_id", "ingested_at", "removed_at").select("src_table", "row_id").distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, parents = _parts(spark, sf_dir)
    return orphan_report(refs, parents, "doc_id", "ingested_at", "removed_at")


_REFS = r"""
refs AS (
  SELECT 'resolutions' AS src_table, mention_id AS row_id, lower(regexp_replace(doc_id, '^\s+|\s+$', '', 'g')) AS k, resolved_at AS t
  FROM resolutions WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT 'evidence', evidence_id, lower(regexp_replace(citing_doc, '^\s+|\s+$', '', 'g')), recorded_at
  FROM evidence WHERE citing_doc IS NOT NULL),
stays AS (SELECT DISTINCT lower(regexp_replace(doc_id, '^\s+|\s+$', '', 'g')) AS k, ingested_at, removed_at FROM judgments),
orphans AS (
  SELECT DISTINCT src_table, row_id, k, t FROM refs r
  WHERE NOT EXISTS (SELECT 1 FROM stays s WHERE s.k = r.k AND s.ingested_at <= r.t AND (s.removed_at IS NULL OR s.removed_at > r.t)))
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
ORACLE = {
    "p1_found": f"WITH {_REFS} SELECT DISTINCT src_table, row_id FROM orphans",
    "p1_report": f"WITH {_REFS} SELECT src_table, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS month, count(DISTINCT row_id) AS orphan_rows, count(DISTINCT k) AS missing_keys FROM orphans GROUP BY ALL",
}
