"""Ranking fusion: per-query normalisation, weighted sums, explained top-k, several configurations at once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The signals, their normalisers and the named weightings.
SIGNALS = ["rel", "cont", "health", "auth"]
MINMAX = {"rel", "auth"}
CONFIGS = {"b0": {"rel": 1.0}, "b1": {"rel": 0.7, "cont": 0.3}, "full": {"rel": 0.5, "cont": 0.2, "health": 0.2, "auth": 0.1}}
SHOWN = 3


def weights(config: Mapping[str, float] | str) -> dict[str, float]:
    """A weighting scaled to a sum of 1; unknown signals, negative or all-zero weights and a zero ``rel`` are errors."""
    w = dict(CONFIGS[config]) if isinstance(config, str) else dict(config)
    if set(w) - set(SIGNALS):
        raise ValueError(f"unknown signals: {sorted(set(w) - set(SIGNALS))}")
    if any(v < 0 for v in w.values()) or w.get("rel", 0) <= 0:
        raise ValueError("weights must not be negative, and rel must weigh something")
    total = sum(w.values())
    return {s: w.get(s, 0.0) / total for s in SIGNALS}


def minmax(value: Column, by: str) -> Column:
    """0 to 1 over a query's candidates; without spread 1 for positive values, else 0."""
    w = Window.partitionBy(by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi == lo, F.when(hi > 0, 1.0).otherwise(0.0)).otherwise((value - lo) / (hi - lo))


def identity(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def normalised(rows: DataFrame, by: str = "qid", strict: bool = False) -> DataFrame:
    """Signals on one scale, as ``n_<signal>``; a missing signal is 0 and a not-a-number one too, or an error if ``strict``."""
    absent = lambda s: F.raise_error(F.concat(F.lit(f"no {s} of "), F.coalesce(F.col("doc_id"), F.lit("a document")))).cast("double") if strict else F.lit(0.0)
    given = {s: F.coalesce(F.when(~F.isnan(s), F.col(s)), absent(s)) for s in SIGNALS}
    return rows.withColumns(given).withColumns({f"n_{s}": minmax(F.col(s), by) if s in MINMAX else identity(F.col(s)) for s in SIGNALS})


def configs_table(df: DataFrame, configs: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(config, w_<signal>...): a row per weighting, a handful."""
    rows = [(name, *[weights(w)[s] for s in SIGNALS]) for name, w in configs.items()]
    return df.sparkSession.createDataFrame(rows, "config string, " + ", ".join(f"w_{s} double" for s in SIGNALS))


def fused(rows: DataFrame, configs: Mapping[str, Mapping[str, float]] = CONFIGS, strict: bool = False) -> DataFrame:
    """Every candidate under every configuration with ``final``: the stated weightings meet each row on its own."""
    n = normalised(rows, strict=strict)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("config"), *[F.lit(weights(w)[s]).alias(f"w_{s}") for s in SIGNALS]) for c, w in configs.items()]))
    wide = n.withColumn("c", each).select("*", "c.*").drop("c")
    return wide.withColumn("final", identity(sum((F.col(f"w_{s}") * F.col(f"n_{s}") for s in SIGNALS), F.lit(0.0))))


def ranked(fused_rows: DataFrame, k: int) -> DataFrame:
    """The k best of each query and configuration: by final, then raw rel, then doc_id."""
    order = Window.partitionBy("qid", "config").orderBy(F.desc(F.round("final", 12)), F.desc("rel"), "doc_id")
    return fused_rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def explanation() -> Column:
    """``signal norm x weight = contribution`` of the signals that weigh, joined by bars."""
    parts = [F.when(F.col(f"w_{s}") > 0, F.format_string(f"{s} %.3f x %.2f = %.3f", f"n_{s}", f"w_{s}", F.col(f"n_{s}") * F.col(f"w_{s}"))) for s in SIGNALS]
    return F.concat_ws(" | ", *parts)


def contributions() -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, SIGNALS)), F.array(*[F.col(f"w_{s}") * F.col(f"n_{s}") for s in SIGNALS]))


def ranks_by_config(ranking: DataFrame, configs: list[str]) -> DataFrame:
    """(qid, doc_id, rank_<config>...): each document's rank under every configuration."""
    return ranking.groupBy("qid", "doc_id").pivot("config", configs).agg(F.min("rank")).select("qid", "doc_id", *[F.col(c).alias(f"rank_{c}") for c in configs])


def violations(hits: DataFrame) -> DataFrame:
    """(qid, doc_id, problem): repeated documents, negative or missing scores in result lists."""
    double = hits.groupBy("qid", "doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("qid", "doc_id", F.lit("repeated").alias("problem"))
    bad = hits.filter(F.col("rel").isNull() | F.isnan("rel") | (F.col("rel") < 0)).select("qid", "doc_id", F.lit("score").alias("problem"))
    return double.union(bad).distinct()
