"""Relevance: zone-weighted and flat BM25, cosine weighting, Okapi's idf, top-k, rank comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.operators.index import ZONE_WEIGHT, ZONES, doc_norms, lengths

K1, B = 1.2, 0.75


def _query(df: DataFrame, words: list[str]) -> DataFrame:
    rows = [(w, words.count(w)) for w in dict.fromkeys(words)]
    return df.sparkSession.createDataFrame(rows or [("", 0)], "term string, qtf int")


def _idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def _saturated(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def bm25_zone(pos: DataFrame, zones: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, rel, one column per zone): each distinct query word scored in each zone, zones weighted.

    A zone's average length is taken over all documents, those without the zone included.
    """
    hits = pos.filter(F.col("term").isin(words)).groupBy("doc_id", "zone", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("term").agg(F.countDistinct("doc_id").alias("df"))
    size = lengths(zones)
    n = size.agg(F.countDistinct("doc_id").alias("n"))
    avg = size.groupBy("zone").agg(F.sum("len").alias("total"))
    table = hits.join(size, ["doc_id", "zone"]).join(F.broadcast(df), "term").join(F.broadcast(avg), "zone").withColumn("n", n.scalar())
    part = table.withColumn("s", _idf(F.col("n"), F.col("df")) * _saturated(F.col("tf"), F.col("len"), F.col("total") / F.col("n")))
    zone = {z: F.coalesce(F.sum(F.when(F.col("zone") == z, F.col("s"))), F.lit(0.0)) for z in ZONES}
    out = part.groupBy("doc_id").agg(*[c.alias(z) for z, c in zone.items()])
    return out.withColumn("rel", sum((F.col(z) * w for z, w in ZONE_WEIGHT.items()), F.lit(0.0)))


def bm25_flat(pos: DataFrame, zones: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, score) over all zones as one text; a word given twice counts twice."""
    q = _query(pos, words)
    hits = pos.join(F.broadcast(q), "term").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("qtf").alias("qtf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = lengths(zones).groupBy("doc_id").agg(F.sum("len").alias("len"))
    whole = size.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    table = hits.join(F.broadcast(df), "term").join(size, "doc_id").withColumns({"n": whole.select("n").scalar(), "avg": whole.select("avg").scalar()})
    return table.groupBy("doc_id").agg(F.sum(F.col("qtf") * _idf(F.col("n"), F.col("df")) * _saturated(F.col("tf"), F.col("len"), F.col("avg"))).alias("score"))


def okapi(pos: DataFrame, zones: DataFrame, words: list[str], epsilon: float = 0.25) -> DataFrame:
    """(doc_id, score) with idf ln((N - n + .5)/(n + .5)); negative idfs become a share of the vocabulary's mean idf."""
    q = _query(pos, words)
    tf = pos.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    vocab = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = lengths(zones).groupBy("doc_id").agg(F.sum("len").alias("len"))
    whole = size.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    n = whole.select("n").scalar()
    idf = vocab.withColumn("idf", F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = idf.agg(F.avg("idf").alias("mean"))
    mine = idf.join(F.broadcast(q), "term").select("term", "qtf", whole.select("avg").scalar().alias("avg"), F.when(F.col("idf") < 0, mean.scalar() * epsilon).otherwise(F.col("idf")).alias("idf"))
    return tf.join(F.broadcast(mine), "term").join(size, "doc_id").groupBy("doc_id").agg(F.sum(F.col("qtf") * F.col("idf") * _saturated(F.col("tf"), F.col("len"), F.col("avg"))).alias("score"))


def lnc_ltc(pos: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, score): (1 + log10 tf) documents against idf-weighted queries, both of length one; 0 where the query's is."""
    q = _query(pos, words)
    hits = pos.join(F.broadcast(q), "term").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("qtf").alias("qtf"))
    n = pos.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    weight = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.first("qtf").alias("qtf")).select("term", ((1 + F.log10("qtf")) * F.log10(n.scalar() / F.col("df"))).alias("wq"))
    norm = weight.agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("qnorm"))
    table = hits.join(F.broadcast(weight), "term").join(doc_norms(pos), "doc_id").withColumn("qnorm", norm.scalar())
    return table.groupBy("doc_id").agg(F.coalesce(F.sum((1 + F.log10("tf")) / F.col("norm") * F.col("wq") / F.nullif("qnorm", F.lit(0.0))), F.lit(0.0)).alias("score"))


def top_k(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best, ties by doc_id: a bounded heap per partition."""
    return scores.orderBy(F.desc(score), "doc_id").limit(max(0, k))


def mean_ranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Ranks from the highest value, ties sharing their mean."""
    w = Window.partitionBy(*by)
    return df.withColumn(out, F.rank().over(w.orderBy(F.desc(value))) + (F.count(F.lit(1)).over(w.partitionBy(*by, value)) - 1) / 2.0)


def rank_agreement(a: DataFrame, b: DataFrame, by: str, item: str, value: str) -> DataFrame:
    """(by, n, spearman) of the items two systems share: Pearson's correlation of mean ranks."""
    both = a.select(by, item, F.col(value).alias("x")).join(b.select(by, item, F.col(value).alias("y")), [by, item])
    ranked = mean_ranks(mean_ranks(both, [by], "x", "rx"), [by], "y", "ry")
    return ranked.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("spearman"))
