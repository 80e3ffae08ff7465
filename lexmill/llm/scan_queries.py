"""Queries of problem 6: repairing scanned judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.scans import flagged_lines, paragraphs
from lexmill.session import load


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "judgments").filter(F.col("doc_id").isNotNull())
    once = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("text_layer").alias("layer"))
    return flagged_lines(once, load(spark, sf_dir, "entries"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir).filter(F.col("page") | F.col("carried") | F.col("word")).filter(~F.col("title")).select("doc_id", "line_no")


def p6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(_flagged(spark, sf_dir))


QUERIES = {"p6_found": p6_found, "p6_paragraphs": p6_paragraphs}
ORACLE: dict[str, str] = {}
