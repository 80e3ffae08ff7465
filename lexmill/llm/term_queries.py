"""Queries of problem 2: term frequencies of judgment texts and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.terms import banded, term_counts
from lexmill.session import load


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its occurrences, records and band (NULL: neither rare nor common)."""
    texts, titles = load(spark, sf_dir, "judgments"), load(spark, sf_dir, "doc_meta")
    counts = term_counts(texts, "doc_id", {"text": "text"}).unionByName(term_counts(titles, "doc_id", {"title": "title"}))
    totals = {f: d.agg(F.countDistinct("doc_id")).first()[0] for f, d in (("text", texts), ("title", titles))}
    return banded(counts, totals)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_terms(spark, sf_dir).filter(F.col("band").isNotNull()).select("field", "term", "band")


_SQL = r"""
WITH src AS (
  SELECT 'text' AS field, doc_id, min(text) AS v FROM judgments WHERE doc_id IS NOT NULL GROUP BY doc_id
  UNION ALL SELECT 'title', doc_id, min(title) FROM doc_meta WHERE doc_id IS NOT NULL GROUP BY doc_id),
tot AS (SELECT field, count(*) AS n FROM src GROUP BY field),
words AS (SELECT field, doc_id, unnest(regexp_extract_all(lower(v), '[\p{L}\p{M}\p{N}]+')) AS term FROM src),
c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM words GROUP BY ALL),
b AS (SELECT field, term, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.3 * n THEN 'common' END AS band FROM c JOIN tot USING (field))
"""

QUERIES = {"p2_found": p2_found, "p2_terms": p2_terms}
ORACLE = {"p2_found": _SQL + "SELECT field, term, band FROM b WHERE band IS NOT NULL", "p2_terms": _SQL + "SELECT * FROM b"}
