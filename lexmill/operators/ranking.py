"""The whole ranking of a query: search, continuity, health, authority, fusion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import boolean, fusion, index, scoring, statutes, stored, treatment
from lexmill.session import materialise

#: Best hits that are ranked.
CANDIDATES = 100


@dataclass(frozen=True)
class Corpus:
    """The tables a ranking reads.  ``zones``: (doc_id, zone, text); ``texts``: (doc_id, date, text);
    ``citations``: (doc_id, citing_doc, label, confidence, valid, in_headnote, citing_bench); ``authority``: (id, authority), computed when the corpus is built.
    With a stored ``index`` and the statute ``references`` of all documents no text is read at query time."""

    zones: DataFrame
    texts: DataFrame
    citations: DataFrame
    authority: DataFrame
    index: stored.Index | None = None
    references: DataFrame | None = None


def statute_references(texts: DataFrame) -> DataFrame:
    """(doc_id, act, section, n, offence_id) of (doc_id, date, text)."""
    mapping = statutes.statute_map(texts.sparkSession)
    return statutes.references(statutes.resolve_acts(statutes.mentions(texts), statutes.section_families(mapping)), statutes.provisions(mapping))


def _scan(corpus: Corpus, query: str, n: int) -> DataFrame:
    """The best hits without a stored index: texts are tokenised for the one query."""
    pos = index.positions(corpus.zones)
    docs, terms = boolean.candidates(query, pos, corpus.zones)
    scored = docs.join(scoring.bm25_zone(pos, corpus.zones, terms), "doc_id", "left").select("doc_id", F.coalesce("rel", F.lit(0.0)).alias("rel"))
    return scoring.top_k(scored, n, "rel")


def signals(corpus: Corpus, query: str, offence_date: str | None = None, n: int = CANDIDATES) -> DataFrame:
    """(qid, doc_id, rel, cont, health, auth, cont_why) of the n best hits of a query."""
    if not query.strip():
        raise ValueError("empty query")
    hits = materialise(stored.search(corpus.index, query, n) if corpus.index else _scan(corpus, query, n), "hits")
    mapping = statutes.statute_map(hits.sparkSession)
    refs = corpus.references
    if refs is None:
        # Statutes are read in the hits only.
        refs = statute_references(corpus.texts.join(F.broadcast(hits.select("doc_id")), "doc_id", "left_semi"))
    else:
        refs = refs.join(F.broadcast(hits.select("doc_id")), "doc_id", "left_semi")
    cont = statutes.query_continuity(hits, refs, statutes.map_pairs(mapping), statutes.parse_query(query, offence_date)[0])
    health = treatment.health(corpus.citations, hits)
    auth = corpus.authority.select(F.col("id").alias("doc_id"), F.col("authority").alias("auth"))
    out = hits.join(cont, "doc_id", "left").join(health, "doc_id", "left").join(auth, "doc_id", "left")
    return out.select(F.lit(query).alias("qid"), "doc_id", "rel", "cont", "health", F.coalesce("auth", F.lit(0.0)).alias("auth"), "cont_why")


def rank(corpus: Corpus, query: str, offence_date: str | None = None, config: str = "full", k: int = 10) -> DataFrame:
    """(rank, doc_id, final, why): the k best of a query under a configuration, explained."""
    rows = fusion.ranked(fusion.fused(signals(corpus, query, offence_date), {config: fusion.CONFIGS[config]}, strict=True), k)
    return rows.select("rank", "doc_id", F.round("final", 6).alias("final"), F.concat_ws(" | ", fusion.explanation(), "cont_why").alias("why"))
