"""How later judgments treat a judgment: label joins, valid negatives, health, ranked evidence, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the health model.
STRENGTH = {"overruled": 0.1, "doubted": 0.6}
MIN_CONFIDENCE, KEPT = 0.5, 5


def strength(label: Column) -> Column:
    return F.coalesce(*[F.when(label == k, v) for k, v in STRENGTH.items()])


def valid_negative(label: Column, citing: Column, cited: Column) -> Column:
    """A negative holds only from a bench at least as large; an unknown bench never does."""
    return F.coalesce(label.isin(list(STRENGTH)) & (citing >= cited), F.lit(False))


def labelled(mentions: DataFrame, cache: DataFrame, key: str, in_scope: Column, strict: bool = False) -> DataFrame:
    """Mentions with label and confidence from a keyed cache; outside the scope neutral, in it NULL (an error if ``strict``) where the cache has none."""
    found = mentions.join(cache.select(key, "label", "confidence"), key, "left")
    if strict:
        found = found.withColumn("label", F.when(in_scope & F.col("label").isNull(), F.raise_error(F.concat(F.lit("no label of "), F.coalesce(F.col(key).cast("string"), F.lit("a mention"))))).otherwise(F.col("label")))
    return found.withColumn("label", F.when(in_scope, F.col("label")).otherwise("neutral")).withColumn("confidence", F.when(in_scope, F.col("confidence")).otherwise(0.0))


def health(citations: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, health): the weakest valid negative of enough confidence, 1 without; a row for every document."""
    hit = citations.filter(F.col("valid") & (F.col("confidence") >= MIN_CONFIDENCE)).groupBy("doc_id").agg(F.min(strength(F.col("label"))).alias("h"))
    return docs.select("doc_id").distinct().join(hit, "doc_id", "left").select("doc_id", F.coalesce("h", F.lit(1.0)).alias("health"))


def evidence_top(citations: DataFrame, kept: int = KEPT) -> DataFrame:
    """(doc_id, place, citing_doc, label): valid negatives by strength, then followings by bench; one per citing and label.

    The first window only dedups on (doc, citing, label); a document that a
    tenth of all rows cite is combined map-side to one row per pair before the
    second.
    """
    negative = F.col("valid") & (F.col("confidence") >= MIN_CONFIDENCE)
    use = citations.withColumn("neg", negative).filter(F.col("neg") | (F.col("label") == "followed"))
    conf = F.coalesce("confidence", F.lit(0.0))
    key = F.struct(
        (~F.col("neg")).cast("int").alias("group"),
        F.when(F.col("neg"), strength(F.col("label"))).otherwise(0.0).alias("s"),
        F.coalesce("in_headnote", F.lit(False)).cast("int").alias("h"),
        F.when(F.col("neg"), 0).otherwise(-F.coalesce("citing_bench", F.lit(0))).alias("b"),
        (-conf).alias("c"),
        F.col("citing_doc").alias("d"),
    )
    once = use.groupBy("doc_id", "citing_doc", "label").agg(F.min(key).alias("k"))
    order = Window.partitionBy("doc_id").orderBy("k", "label")
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= kept).select("doc_id", "place", "citing_doc", "label")


def point_health(evidence: DataFrame, offences: Column) -> DataFrame:
    """(doc_id, health) for given offences: a negative counts if it names none or one of them."""
    touches = (F.size("offence_ids") == 0) | F.arrays_overlap("offence_ids", offences)
    return evidence.groupBy("doc_id").agg(F.coalesce(F.min(F.when(touches, strength(F.col("label")))), F.lit(1.0)).alias("health"))


def few_shot_pool(windows: DataFrame, per_label: int) -> DataFrame:
    """The first windows of each label in sha1 order."""
    return windows.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy(F.sha1("window"), "window"))).filter(F.col("rn") <= per_label)


def water_fill(sizes: dict[str, int], total: int) -> dict[str, int]:
    """Equal quotas up to each size: everyone gets the water level, the units left over go to the first names above it."""
    total = min(total, sum(sizes.values()))
    level, below = 0, 0
    # Bucket by bucket from the smallest: the level is what is left, shared by those not yet full.
    for filled, n in enumerate(sorted(sizes.values())):
        level = (total - below) // (len(sizes) - filled)
        if level < n:
            break
        below += n
    quota = {k: min(n, level) for k, n in sizes.items()}
    above = sorted(k for k, n in sizes.items() if n > level)
    return quota | {k: level + 1 for k in above[: total - sum(quota.values())]}


def stratified_sample(windows: DataFrame, total: int, seed: int) -> DataFrame:
    """A sample over the buckets of ``bucket`` by water-filled quotas, in seeded hash order; sampling is what it is for."""
    sizes = {r["bucket"]: r["n"] for r in windows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    quota = water_fill(sizes, total)
    if not quota:
        return windows.withColumn("rn", F.lit(0)).limit(0)
    at = F.coalesce(*[F.when(F.col("bucket") == k, n) for k, n in quota.items()])
    order = Window.partitionBy("bucket").orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), "id"), 256), "id")
    return windows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= at)


def batch_labels(windows: DataFrame, call, batch: int = 30) -> DataFrame:
    """(key, label, confidence) of uncached windows by an injected labeller: ``call`` takes a list of texts and gives JSON.

    The answer is parsed strictly: an item whose label or confidence cannot be
    read is NULL, so that it stays uncached and is asked again.
    """
    import pandas as pd

    def ask(batches):
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                yield pd.DataFrame({"key": part["key"], "answer": list(call(list(part["window"])))})

    answers = windows.select("key", "window").distinct().mapInPandas(ask, "key string, answer string")
    parsed = answers.withColumn("a", F.from_json("answer", "label string, confidence double"))
    return parsed.select("key", F.col("a.label").alias("label"), F.when(F.col("a.confidence").between(0, 1), F.col("a.confidence")).alias("confidence"))


def merged_gold(a: DataFrame, b: DataFrame, settled: DataFrame) -> DataFrame:
    """(window_id, label, state) of two labelling sheets: agreed, adjudicated, unresolved, or only in one of them."""
    both = a.select("window_id", F.col("label").alias("la")).join(b.select("window_id", F.col("label").alias("lb")), "window_id", "full_outer")
    all_ = both.join(settled.select("window_id", F.col("label").alias("ls")), "window_id", "left")
    state = F.when(F.col("la").isNull() | F.col("lb").isNull(), "missing").when(F.col("la") == F.col("lb"), "agreed").when(F.col("ls").isNotNull(), "adjudicated").otherwise("unresolved")
    return all_.select("window_id", F.when(state == "agreed", F.col("la")).when(state == "adjudicated", F.col("ls")).alias("label"), state.alias("state"))


def both_sides(rows: DataFrame, by: str, label: str, one: str, other: str) -> DataFrame:
    """Groups that have both labels."""
    return rows.groupBy(by).agg(F.bool_or(F.col(label) == one).alias("_a"), F.bool_or(F.col(label) == other).alias("_b")).filter(F.coalesce(F.col("_a") & F.col("_b"), F.lit(False))).select(by)
