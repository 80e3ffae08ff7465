"""Queries of problem 9: documents that were cut off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.truncation import truncated, truncation_report
from lexmill.session import load


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(load(spark, sf_dir, "documents"), "doc_id", "text", "source")[0].filter("truncated").select("doc_id").distinct()


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_report(load(spark, sf_dir, "documents"), "doc_id", "text", "source")


QUERIES = {"p9_found": p9_found, "p9_report": p9_report}
ORACLE: dict[str, str] = {}
