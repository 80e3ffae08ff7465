"""python -m lexmill.cli DIR QUERY [--date YYYY-MM-DD] [--config full] [-k 10]: rank the judgments of a data folder."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lexmill.operators import fusion
from lexmill.operators.ranking import rank
from lexmill.plans.rank_queries import corpus


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser()
    p.add_argument("folder")
    p.add_argument("query")
    p.add_argument("--date")
    p.add_argument("--config", choices=list(fusion.CONFIGS), default="full")
    p.add_argument("-k", type=int, default=10)
    a = p.parse_args(argv)
    if not 1 <= a.k <= 50 or len(a.query) > 500 or not a.query.strip():
        print("the query must have 1 to 500 characters and k be 1 to 50", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("lexmill").getOrCreate()
    rows = rank(corpus(spark, a.folder), a.query, a.date, a.config, a.k).orderBy("rank").collect()
    for r in rows:
        print(f"{r['rank']:>3} {r['doc_id']:<24} {r['final']:.3f} {'#' * int(20 * r['final']):<20} {r['why']}")
    return 0 if rows else 3


if __name__ == "__main__":
    sys.exit(main())
