"""The inverted index as DataFrames: positions, postings, vocabulary, lengths, norms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import tokens

# The zones in document order and their weights.
ZONES = ["headnote", "facts", "arguments", "holding"]
ZONE_WEIGHT = {"headnote": 3.0, "facts": 1.0, "arguments": 0.75, "holding": 2.5}


def zone_texts(judgments: DataFrame) -> DataFrame:
    """(doc_id, zone, text): one row per document and zone; rows of one document carry the same zones."""
    long = judgments.filter(F.col("doc_id").isNotNull()).select("doc_id", F.explode("zones").alias("zone", "text"))
    return long.filter(F.col("zone").isin(ZONES)).groupBy("doc_id", "zone").agg(F.min("text").alias("text"))


def positions(zones: DataFrame) -> DataFrame:
    """(doc_id, zone, pos, term), positions from 0 inside each zone."""
    return zones.select("doc_id", "zone", F.posexplode(tokens(F.col("text"))).alias("pos", "term"))


def postings(pos: DataFrame) -> DataFrame:
    """(term, doc_id, tf, zone_tf, positions): one row per term and document; positions of all zones together.

    A list holds one document's positions of one term, so its length is bounded by the document.
    """
    zone_tf = F.struct(*[F.count_if(F.col("zone") == z).alias(z) for z in ZONES])
    return pos.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), zone_tf.alias("zone_tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def write_index(pos: DataFrame, path: str, files: int) -> None:
    """Store postings sorted by term, so that a term's lookup reads the row groups whose range holds it."""
    postings(pos).repartitionByRange(files, "term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)


def vocabulary(pos: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    per_doc = pos.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def top_terms(pos: DataFrame, n: int) -> DataFrame:
    return vocabulary(pos).orderBy(F.desc("df"), "term").limit(n)


def lengths(zones: DataFrame) -> DataFrame:
    """(doc_id, zone, len) with zones that have no token left in; lengths already counted are taken as they are."""
    if "len" in zones.columns:
        return zones.select("doc_id", "zone", "len")
    return zones.select("doc_id", "zone", F.size(tokens(F.col("text"))).alias("len"))


def doc_norms(pos: DataFrame) -> DataFrame:
    """(doc_id, norm): the length of the document's (1 + log10 tf) vector."""
    tf = pos.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return tf.groupBy("doc_id").agg(F.sqrt(F.sum(F.pow(1 + F.log10("tf"), F.lit(2.0)))).alias("norm"))


def collection_stats(zones: DataFrame) -> DataFrame:
    """One row: documents, tokens, average length of a document and of each zone over *all* documents."""
    per = lengths(zones)
    docs = F.countDistinct("doc_id")
    each = [(F.sum(F.when(F.col("zone") == z, F.col("len")).otherwise(0)) / docs).alias(f"avg_{z}") for z in ZONES]
    return per.agg(docs.alias("docs"), F.sum("len").alias("tokens"), (F.sum("len") / docs).alias("avg_len"), *each)
