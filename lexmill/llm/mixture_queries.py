"""Queries of problem 8: a mixture of the documents at the target shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.mixture import mixture, shares
from lexmill.session import load


#: A parameter of these queries: the domain of each source of this corpus.
DOMAINS = {
    "sc_reports": "courts", "hc_orders": "courts", "tribunal_notes": "courts", "gazette_scans": "courts",
    "law_digest": "commentary", "statute_notes": "commentary", "bar_blog": "commentary", "moot_archive": "commentary",
    "qa_forum": "public", "translations": "public",
}


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(load(spark, sf_dir, "documents"), load(spark, sf_dir, "source_targets"), domains=DOMAINS)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = load(spark, sf_dir, "source_targets")
    return shares(mixture(load(spark, sf_dir, "documents"), targets, domains=DOMAINS), targets)


QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares}
ORACLE: dict[str, str] = {}
