"""All core queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.plans import corpus_queries, index_queries, law_queries, more_queries, orphan_queries, rank_eval_queries, rank_queries

MODULES = [orphan_queries, index_queries, rank_eval_queries, law_queries, corpus_queries, more_queries, rank_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_queries.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLE.items()}
