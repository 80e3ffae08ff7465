"""Queries of problem 4: the sentences of judgments and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.sentences import sentences
from lexmill.session import load


def _once(df: DataFrame, key: str, text: str) -> DataFrame:
    """One text per key, combined before the shuffle."""
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("k")).agg(F.min(text).alias("t"))


def _split(spark: SparkSession, sf_dir: str, digital: bool) -> DataFrame:
    texts = load(spark, sf_dir, "judgments")
    if digital:
        texts = texts.filter(F.col("text_layer") == "digital")
    parts = [("judgments", _once(texts, "doc_id", "text")), ("evidence", _once(load(spark, sf_dir, "evidence"), "evidence_id", "sentence"))]
    a, b = (sentences(df, "k", "t").select(F.lit(name).alias("src_table"), F.col("key").alias("row_key"), "sent_no", "sent_start", "sent_end") for name, df in parts)
    return a.unionByName(b)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, digital=True).select("src_table", "row_key", "sent_start", "sent_end")


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all texts, scanned ones as their lines stand."""
    return _split(spark, sf_dir, digital=False)


QUERIES = {"p4_found": p4_found, "p4_sentences": p4_sentences}
ORACLE: dict[str, str] = {}
