"""Queries of problem 3: one order of each query's candidates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.ranks import median_rank_order
from lexmill.session import load

SIGNALS = {"rel": 1.0, "cont": 1.0, "health": 1.0, "auth": 1.0}
#: More systems than this are no systems but a column mistaken for one; they are refused, never dropped.
MOST_SYSTEMS = 200


def p3_signal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of ``signal_rows`` by the four scores of ``raw``; an empty or NULL map is an item without scores."""
    rows = load(spark, sf_dir, "signal_rows").select("qid", "doc_id", F.explode_outer("raw").alias("score", "value"))
    return median_rank_order(rows, "qid", "doc_id", "score", "value", SIGNALS)


def hit_order(hits: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """The candidates of each query by the systems' rel; without ``weights`` every system in ``hits`` weighs the same."""
    rows = hits.select("qid", "doc_id", "system_name", "rel")
    if weights is None:
        names = [r[0] for r in rows.select("system_name").filter(F.col("system_name").isNotNull()).distinct().limit(MOST_SYSTEMS + 1).collect()]
        if len(names) > MOST_SYSTEMS:
            raise ValueError(f"more than {MOST_SYSTEMS} systems: name those that count")
        weights = dict.fromkeys(names, 1.0) or {"": 1.0}
    return median_rank_order(rows, "qid", "doc_id", "system_name", "rel", weights)


def p3_hit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of ``hits`` by the systems' rel, each system weighing the same."""
    return hit_order(load(spark, sf_dir, "hits"))


def _sql(source: str, names: str) -> str:
    return f"""
WITH base AS ({source}),
items AS (SELECT DISTINCT g, i FROM base WHERE g IS NOT NULL AND i IS NOT NULL),
sizes AS (SELECT g, count(*) AS n_items FROM items GROUP BY g),
names AS ({names}),
best AS (SELECT g, i, s, max(v) AS v FROM base JOIN names USING (s) WHERE v IS NOT NULL AND NOT isnan(v) AND g IS NOT NULL AND i IS NOT NULL GROUP BY ALL),
r AS (SELECT g, i, s, rank() OVER (PARTITION BY g, s ORDER BY v DESC) + (count(*) OVER (PARTITION BY g, s, v) - 1) / 2.0 AS r FROM best),
ns AS (SELECT g, s, count(*) AS n_s FROM best GROUP BY ALL),
full_r AS (
  SELECT it.g, it.i, n.s, coalesce(r.r, (sz.n_items + coalesce(ns.n_s, 0) + 1) / 2.0) AS r
  FROM items it JOIN sizes sz USING (g) CROSS JOIN names n LEFT JOIN r ON r.g = it.g AND r.i = it.i AND r.s = n.s LEFT JOIN ns ON ns.g = it.g AND ns.s = n.s),
m AS (SELECT g, i, median(r) AS median_rank, avg(r) AS mean_rank FROM full_r GROUP BY ALL)
SELECT g AS qid, i AS doc_id, median_rank, mean_rank, row_number() OVER (PARTITION BY g ORDER BY median_rank, mean_rank, i) AS position FROM m
"""


QUERIES = {"p3_signal_order": p3_signal_order, "p3_hit_order": p3_hit_order}
ORACLE = {
    "p3_signal_order": _sql(
        "SELECT qid AS g, doc_id AS i, unnest(map_keys(raw)) AS s, unnest(map_values(raw)) AS v FROM signal_rows UNION ALL SELECT qid, doc_id, NULL, NULL FROM signal_rows",
        "SELECT unnest(['rel', 'cont', 'health', 'auth']) AS s",
    ),
    "p3_hit_order": _sql("SELECT qid AS g, doc_id AS i, system_name AS s, rel AS v FROM hits", "SELECT DISTINCT system_name AS s FROM hits WHERE system_name IS NOT NULL"),
}
