"""Queries of problem 7: evaluation passages in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.leaks import leak_report, leaked_pairs
from lexmill.session import load


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_pairs(load(spark, sf_dir, "documents"), "doc_id", "text", load(spark, sf_dir, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(_pairs(spark, sf_dir), load(spark, sf_dir, "eval_items"), "item_id")


QUERIES = {"p7_found": p7_found, "p7_leaks": p7_leaks}
ORACLE: dict[str, str] = {}
