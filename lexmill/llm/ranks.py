"""One ranking from several differently-scaled scores: weighted median rank aggregation.

Every item is ranked within its group in each score (highest first, ties share
their mean rank).  An item that a score leaves out takes the mean of the ranks
left over below the ranked items.  Items are ordered by the weighted median of
their ranks, then by the weighted mean rank, then by identifier.  Only ranks
enter the order, so no score weighs more because its numbers are larger, and a
constant score moves nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.session import materialise

#: A group of more rows than this is not sorted by one task but in ranges of about so many rows.
SLICE_ROWS = 100_000


def _preceding(df: DataFrame, group: list[str], order: list[Column], amount: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over the rows of the group before this one in ``order``, without a group in one task.

    The rows are range-partitioned by group and order and written, so that the
    ranges stay as they are if an executor is lost; a group's sums over whole
    ranges give the offsets.  ``order`` tells all rows of a group apart.
    """
    ranges = max(1, -(-df.count() // SLICE_ROWS))
    cut = materialise(df.withColumn("_a", amount).repartitionByRange(ranges, *map(F.col, group), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*group, "_range").agg(F.sum("_a").alias("_s")).select(*group, "_range", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(offsets, [*group, "_range"]).withColumn(out, F.col("_offset") + F.coalesce(F.sum("_a").over(inside), F.lit(0))).drop("_a", "_range", "_offset")


def ranked(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Add the mean rank of ``value`` (highest 1, ties share, NULLs last) in its group, for groups of any size.

    Ranks are made from the counts of distinct values, so a value that a third
    of all rows share is one row there and is joined back to them.
    """
    counts = df.groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = _preceding(counts, group, [F.desc_nulls_last("_v")], F.col("_n"), "_before")
    return df.join(placed.withColumnsRenamed({g: f"_{g}" for g in group}), [df[g] == F.col(f"_{g}") for g in group] + [df[value].eqNullSafe(F.col("_v"))]).select(*df.columns, (F.col("_before") + (F.col("_n") + 1) / F.lit(2.0)).alias(out))


def median_rank_order(scores: DataFrame, group: str, item: str, score: str, value: str, weights: Mapping[str, float]) -> DataFrame:
    """(group, item, median_rank, mean_rank, position) from long scores (group, item, score, value).

    ``weights`` names the scores that count and their weights; other scores are
    left out.  Repeated rows count once; of several values of one item in one
    score the largest counts.  NULL and NaN values are absent scores; rows with
    a NULL group or item are left out; an item without any value still gets a
    place (it ties last in every score).  No rows give no rows.  Extra columns
    are ignored.
    """
    names = sorted(weights)
    base = scores.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).alias("s"), F.col(value).cast("double").alias("v")).filter(F.col("g").isNotNull() & F.col("i").isNotNull())
    # One row per item with a column per score, combined before the one shuffle by item.
    wide = base.groupBy("g", "i").agg(*[F.max(F.when((F.col("s") == n) & ~F.isnan("v"), F.col("v"))).alias(f"v{k}") for k, n in enumerate(names)])
    wide = materialise(wide, "scores")
    sizes = wide.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    # At most rows / SLICE_ROWS groups are large.
    large = sizes.filter(F.col("n") > SLICE_ROWS).select("g")
    if not large.limit(1).count():
        return _placed(_medians(_window_ranks(wide, len(names)), weights), group, item)
    small, rest = wide.join(large, "g", "left_anti"), wide.join(large, "g", "left_semi")
    for k in range(len(names)):
        rest = ranked(rest, ["g"], f"v{k}", f"r{k}")
    medians = _medians(rest, weights)
    order = [F.col(c) for c in ("median_rank", "mean_rank", "i")]
    placed = _preceding(medians, ["g"], order, F.lit(1), "position").withColumn("position", F.col("position") + 1)
    named = placed.select(F.col("g").alias(group), F.col("i").alias(item), "median_rank", "mean_rank", "position")
    return _placed(_medians(_window_ranks(small, len(names)), weights), group, item).unionByName(named)


def _window_ranks(wide: DataFrame, n: int) -> DataFrame:
    """Mean ranks of groups that one task can sort: all windows share the one partitioning by group."""
    for k in range(n):
        order = Window.partitionBy("g").orderBy(F.desc_nulls_last(f"v{k}"))
        tied = order.rangeBetween(Window.currentRow, Window.currentRow)
        wide = wide.withColumn(f"r{k}", F.rank().over(order) + (F.count(F.lit(1)).over(tied) - 1) / F.lit(2.0))
    return wide


def _medians(ranks: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """(g, i, median_rank, mean_rank) from the rank columns, in the order of the sorted names."""
    entries = F.array_sort(F.array(*[F.struct(F.col(f"r{k}").alias("r"), F.lit(float(weights[n])).alias("w")) for k, n in enumerate(sorted(weights))]))
    half = sum(float(w) for w in weights.values()) / 2.0
    # The weighted median: the mean of the first rank whose cumulated weight reaches half and the first that exceeds it.
    cumulated = F.aggregate(
        "e",
        F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")),
        lambda acc, x: F.struct(
            (acc["w"] + x["w"]).alias("w"),
            F.coalesce(acc["lo"], F.when(acc["w"] + x["w"] >= half, x["r"])).alias("lo"),
            F.coalesce(acc["hi"], F.when(acc["w"] + x["w"] > half, x["r"])).alias("hi"),
        ),
        lambda acc: (acc["lo"] + F.coalesce(acc["hi"], acc["lo"])) / 2.0,
    )
    mean = F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x["r"] * x["w"]) / F.lit(2 * half)
    return ranks.withColumn("e", entries).select("g", "i", cumulated.alias("median_rank"), mean.alias("mean_rank"))


def _placed(medians: DataFrame, group: str, item: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("g").orderBy("median_rank", "mean_rank", "i")).cast("long")
    return medians.select(F.col("g").alias(group), F.col("i").alias(item), "median_rank", "mean_rank", at.alias("position"))
