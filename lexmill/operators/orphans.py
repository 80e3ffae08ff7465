"""References to records that do not exist, found with compressed bitmaps.

Keys are dictionary-encoded as (key range, ordinal).  Per key range and period
a bitmap is a map from word number to 64 bits in which all-zero words are left
out.  The reference bitmap AND-NOT the parent bitmap leaves the bits of the
orphans, which are decoded to keys and joined to the referring rows.

Two parent bitmaps are kept for each period: keys held at *any* time in it and
keys held *throughout*.  A reference bit outside the first is an orphan for
every row of the period; a bit in the first but not in the second is decided
row by row against the stays of its key.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Distinct keys of both sides to one key range; a range is one task's sort and one container per period.
KEYS_PER_RANGE = 16_384
WORD_BITS = 64
_STAY = "array<struct<since:timestamp,until:timestamp>>"


@dataclass(frozen=True)
class Reference:
    """One referring table: its rows' id, the key it refers to and the time the reference was made."""

    df: DataFrame
    row_id: str
    key: str
    at: str


def normal_key(key: Column) -> Column:
    """Keys compare without surrounding blanks and regardless of letter case."""
    return F.lower(F.regexp_replace(key, r"^\s+|\s+$", ""))


def month_no(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at) - 1


def month_name(no: Column) -> Column:
    return F.when(no.isNotNull(), F.format_string("%04d-%02d", F.floor(no / 12).cast("int"), (no % 12 + 1).cast("int")))


def _month_start(no: Column) -> Column:
    return F.make_timestamp(F.floor(no / 12).cast("int"), (no % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))


def referring_rows(references: Mapping[str, Reference]) -> DataFrame:
    """(src_table, row_id, key, at, period) of every reference that is not NULL, duplicates included."""
    parts = [
        r.df.select(
            F.lit(name).alias("src_table"),
            F.col(r.row_id).cast("long").alias("row_id"),
            normal_key(F.col(r.key)).alias("key"),
            F.col(r.at).alias("at"),
        ).filter(F.col("key").isNotNull())
        for name, r in references.items()
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.withColumn("period", month_no(F.col("at")))


def _encoded(rows: DataFrame, parents: DataFrame, key: str, since: str, until: str, ranges: int) -> DataFrame:
    """Keys of both sides with their dictionary code (rng, ord).

    Kind ``ref``: one row per (src_table, key, period).  Kind ``par``: one row
    per parent key with its stays.  Both are aggregated map-side before the one
    shuffle by key range, so a key that a third of all rows name is a handful
    of rows here.
    """
    refs = (
        rows.filter(F.col("at").isNotNull())
        .groupBy("key", "src_table", "period")
        .agg(F.lit(1).alias("one"))
        .select("key", "src_table", "period", F.lit(None).cast(_STAY).alias("stays"))
    )
    stay = F.struct(F.col(since).cast("timestamp").alias("since"), F.col(until).cast("timestamp").alias("until"))
    pars = (
        parents.select(normal_key(F.col(key)).alias("key"), stay.alias("stay"))
        .filter(F.col("key").isNotNull() & F.col("stay.since").isNotNull())
        .filter(F.col("stay.until").isNull() | (F.col("stay.until") > F.col("stay.since")))
        .groupBy("key")
        .agg(F.sort_array(F.collect_set("stay")).alias("stays"))
        .select("key", F.lit(None).cast("string").alias("src_table"), F.lit(None).cast("int").alias("period"), "stays")
    )
    by_range = Window.partitionBy("rng").orderBy("key")
    return (
        refs.unionByName(pars)
        .withColumn("rng", F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int"))
        .withColumn("ord", F.dense_rank().over(by_range) - 1)
        .withColumn("stays", F.first("stays", ignorenulls=True).over(by_range.rangeBetween(Window.currentRow, Window.currentRow)))
    )


def _bitmaps(coded: DataFrame, tables: list[str], first: int, last: int) -> DataFrame:
    """(rng, period, ref_<i> map, par_any map, par_all map): the containers of the periods from first to last."""
    word = F.floor(F.col("ord") / WORD_BITS).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("ord") % WORD_BITS).cast("int"))
    refs = coded.filter(F.col("src_table").isNotNull()).select("rng", "period", word.alias("word"), F.col("src_table").alias("owner"), bit.alias("bit"))
    stay = (
        coded.filter(F.col("src_table").isNull())
        .select("rng", "ord", F.explode("stays").alias("s"))
        .select("rng", "ord", "s", F.greatest(month_no(F.col("s.since")), F.lit(first)).alias("a"), F.least(F.coalesce(month_no(F.col("s.until")), F.lit(last)), F.lit(last)).alias("b"))
        .filter(F.col("a") <= F.col("b"))
        .select("rng", "ord", "s", F.explode(F.sequence("a", "b")).alias("period"))
    )
    whole = (F.col("s.since") <= _month_start(F.col("period"))) & (F.col("s.until").isNull() | (F.col("s.until") >= _month_start(F.col("period") + 1)))
    held = stay.select("rng", "period", word.alias("word"), F.explode(F.when(whole, F.array(F.lit("par_any"), F.lit("par_all"))).otherwise(F.array(F.lit("par_any")))).alias("owner"), bit.alias("bit"))
    words = refs.unionByName(held).groupBy("rng", "period", "word", "owner").agg(F.bit_or("bit").alias("bits"))
    pair = F.struct(F.col("word"), F.col("bits"))
    owners = {f"ref_{i}": t for i, t in enumerate(tables)} | {"par_any": "par_any", "par_all": "par_all"}
    return words.groupBy("rng", "period").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("owner") == t, pair))).alias(c) for c, t in owners.items()])


def _and_not(ref: Column, parent: Column) -> Column:
    return F.map_zip_with(ref, parent, lambda _w, r, p: F.coalesce(r, F.lit(0).cast("long")).bitwiseAND(F.bitwise_not(F.coalesce(p, F.lit(0).cast("long")))))


def _decoded(maps: DataFrame, tables: list[str]) -> DataFrame:
    """Surviving bits as (src_table, rng, ord, period, absent)."""
    per_table = F.array(*[F.struct(F.lit(t).alias("src_table"), _and_not(F.col(f"ref_{i}"), F.col("par_all")).alias("open")) for i, t in enumerate(tables)])
    words = (
        maps.select("rng", "period", "par_any", F.explode(per_table).alias("x"))
        .select("rng", "period", "par_any", F.col("x.src_table").alias("src_table"), F.explode("x.open").alias("word", "bits"))
        .filter(F.col("bits") != 0)
        .withColumn("any_bits", F.coalesce(F.try_element_at("par_any", "word"), F.lit(0).cast("long")))
        .drop("par_any")
    )
    at = F.explode(F.filter(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda i: F.getbit(F.col("bits"), i) == 1)).alias("i")
    return words.select("src_table", "rng", "period", "word", "any_bits", at).select(
        "src_table", "rng", "period", (F.col("word") * WORD_BITS + F.col("i")).alias("ord"), (F.getbit(F.col("any_bits"), F.col("i")) == 0).alias("absent")
    )


def orphan_rows(references: Mapping[str, Reference], parents: DataFrame, key: str, since: str, until: str, ranges: int | None = None) -> DataFrame:
    """(src_table, row_id, period): referring rows whose key no parent row held at their time.

    A parent row holds its key from ``since`` (inclusive) to ``until``
    (exclusive; NULL: still).  References that are NULL are no rows; a
    reference without a time can be held by no stay and is an orphan with a
    NULL period.  Repeated rows give one row, an empty parent table makes every
    reference an orphan, empty referring tables give none.  Parent rows with a
    NULL key or start, or that end before they start, hold nothing.
    """
    tables = list(references)
    rows = referring_rows(references)
    lo, hi, named_keys = rows.agg(F.min("period"), F.max("period"), F.approx_count_distinct("key")).first()
    if ranges is None:
        # Missing keys are coded too, so both sides decide; an estimate will do, as any number of ranges gives the same rows.
        held_keys = parents.agg(F.approx_count_distinct(normal_key(F.col(key)))).first()[0]
        ranges = max(1, -(-(named_keys + held_keys) // KEYS_PER_RANGE))
    coded = _encoded(rows, parents, key, since, until, ranges)
    open_bits = _decoded(_bitmaps(coded, tables, *((lo, hi) if lo is not None else (0, -1))), tables)
    named = coded.filter(F.col("src_table").isNotNull())
    missing = named.join(open_bits, ["src_table", "rng", "ord", "period"]).select("src_table", "key", "period", "absent", "stays")
    held = F.exists("stays", lambda s: (s["since"] <= F.col("at")) & (s["until"].isNull() | (s["until"] > F.col("at"))))
    found = (
        rows.join(missing, ["src_table", "key", "period"])
        .filter(F.col("absent") | ~F.coalesce(held, F.lit(False)))
        .select("src_table", "row_id", "key", "period")
    )
    timeless = rows.filter(F.col("at").isNull()).select("src_table", "row_id", "key", "period")
    return found.unionByName(timeless).distinct()


def orphan_report(references: Mapping[str, Reference], parents: DataFrame, key: str, since: str, until: str) -> DataFrame:
    """(src_table, month, orphan_rows, missing_keys) per referring table and month, NULL month for rows without a time."""
    return (
        orphan_rows(references, parents, key, since, until)
        .groupBy("src_table", month_name(F.col("period")).alias("month"))
        .agg(F.countDistinct("row_id").alias("orphan_rows"), F.countDistinct("key").alias("missing_keys"))
    )
