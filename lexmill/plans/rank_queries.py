"""The flagship: a whole ranking, and the steps that read free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import classifier, evaluation, graph, index, stored, zones
from lexmill.operators.ranking import Corpus, rank, signals, statute_references
from lexmill.plans import law_queries
from lexmill.session import load, once

QUERY = "confession AND (murder OR recovery OR evidence)"


def corpus(spark: SparkSession, sf: str) -> Corpus:
    """What a ranking reads, stored by the first query of an application: the stemmed index, authority to convergence, statutes, citations."""
    zones_of = lambda: index.zone_texts(load(spark, sf, "judgments").select("doc_id", "zones"))
    auth = once(spark, f"authority {sf}", lambda: graph.authority(graph.pagerank(law_queries._edges(spark, sf)), law_queries._benches(spark, sf)))
    refs = once(spark, f"statutes {sf}", lambda: statute_references(law_queries._docs(spark, sf)).repartition("doc_id").sortWithinPartitions("doc_id"))
    cites = once(spark, f"citations {sf}", lambda: law_queries._citations(spark, sf))
    return Corpus(zones_of(), law_queries._docs(spark, sf), cites, auth, stored.once(spark, sf, zones_of), refs)


def rank_full(spark, sf):
    """search, continuity, health, authority and fusion for one query."""
    return rank(corpus(spark, sf), QUERY, "2020-01-01")


def rank_signals(spark, sf):
    """the signals of the candidates."""
    return signals(corpus(spark, sf), "section 302 IPC", "2020-01-01").select("doc_id", *[F.round(c, 6).alias(c) for c in ("rel", "cont", "health", "auth")])


def zone_split(spark, sf):
    """Zones read from the texts, by length."""
    return zones.zones(law_queries._docs(spark, sf), "doc_id", "text").select(F.col("key").alias("doc_id"), "zone", F.length("text").alias("n"))


def coram_benches(spark, sf):
    """The bench from the coram line of the text."""
    return zones.benches(law_queries._docs(spark, sf), "doc_id", "text").select(F.col("key").alias("doc_id"), "bench", F.array_join("judges", "; ").alias("judges"))


def classifier_report(spark, sf):
    """Labels predicted for held-out evidence (every fifth row by hash), per class."""
    e = load(spark, sf, "evidence").select(F.col("sentence").alias("window"), "label").distinct().filter("window is not null and label is not null").withColumn("fold", F.pmod(F.xxhash64("window"), F.lit(5)))
    model = classifier.fit(e.filter("fold <> 0"))
    return evaluation.class_report(classifier.predict(model, e.filter("fold = 0")), "label", "pred")


QUERIES: dict = {f.__name__: f for f in (rank_full, rank_signals, zone_split, coram_benches, classifier_report)}
ORACLE: dict[str, str] = {}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return rank_full(spark, sf)
