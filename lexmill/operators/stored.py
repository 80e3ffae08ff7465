"""A stored index: postings sorted by term, lengths, norms, vocabulary and totals, and searches that read only what a query names.

A query filters on its terms, so of the postings only the row groups whose
range holds them are read; norms and lengths are joined to the hits; totals
are one stored row.  Nothing of the texts is read at query time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window  # noqa: F401

from lexmill.functions.stem import stem_tokens
from lexmill.functions.text import tokens
from lexmill.operators import boolean, index, scoring
from lexmill.session import exists, own_dir

TABLES = ["postings", "lengths", "norms", "vocabulary", "totals"]
#: Postings to a file.
PER_FILE = 5_000_000


@dataclass(frozen=True)
class Index:
    """``postings``: (term, doc_id, zone, tf, positions); ``lengths``: (doc_id, zone, len); ``norms``: (doc_id, norm, len);
    ``vocabulary``: (term, df, cf); ``totals``: one row (docs, avg_len, mean_idf, avg_<zone>...); ``stems``: whether terms are stems."""

    postings: DataFrame
    lengths: DataFrame
    norms: DataFrame
    vocabulary: DataFrame
    totals: DataFrame
    stems: bool

    @property
    def positions(self) -> DataFrame:
        """(doc_id, zone, pos, term), for Boolean, phrase and proximity search; a filter on terms reaches the scan."""
        return self.postings.select("doc_id", "zone", "term", F.explode("positions").alias("pos"))

    def words(self, text: str) -> list[str]:
        """A query's terms as the index has them."""
        return boolean.query_tokens(text, self.stems)


def write(zones: DataFrame, path: str, stems: bool = True) -> None:
    """Build the index of (doc_id, zone, text) under ``path``.  Texts are tokenised once; zones without a token count as empty."""
    spark = zones.sparkSession
    terms = tokens(F.col("text"))
    zones.select("doc_id", "zone", (stem_tokens(terms) if stems else terms).alias("terms")).write.mode("overwrite").parquet(f"{path}/tokens")
    tokenised = spark.read.parquet(f"{path}/tokens")
    tokenised.select("doc_id", "zone", F.size("terms").alias("len")).write.mode("overwrite").parquet(f"{path}/lengths")
    pos = tokenised.select("doc_id", "zone", F.posexplode("terms").alias("pos", "term"))
    # A list holds the places of one term in one zone of one document, so it is bounded by the document.
    postings = pos.groupBy("term", "doc_id", "zone").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    count = tokenised.agg(F.sum(F.size(F.array_distinct("terms")))).first()[0] or 0
    postings.repartitionByRange(max(1, -(-count // PER_FILE)), "term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    per_doc = stored.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))
    norm = per_doc.groupBy("doc_id").agg(F.sqrt(F.sum(F.pow(1 + F.log10("tf"), F.lit(2.0)))).alias("norm"), F.sum("tf").alias("len"))
    spark.read.parquet(f"{path}/lengths").select("doc_id").distinct().join(norm, "doc_id", "left").fillna(0, ["norm", "len"]).write.mode("overwrite").parquet(f"{path}/norms")
    per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).sort("term").write.mode("overwrite").parquet(f"{path}/vocabulary")
    stats = index.collection_stats(spark.read.parquet(f"{path}/lengths"))
    okapi = F.ln((stats.select("docs").scalar() - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = spark.read.parquet(f"{path}/vocabulary").agg(F.avg(okapi).alias("mean_idf"))
    stats.withColumn("mean_idf", mean.scalar()).write.mode("overwrite").parquet(f"{path}/totals")


def read(spark: SparkSession, path: str, stems: bool = True) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in TABLES), stems)


def once(spark: SparkSession, name: str, zones: Callable[[], DataFrame], stems: bool = True) -> Index:
    """The index called ``name`` of this application: built in the shared folder by the first query, read by all later ones."""
    path = f"{own_dir(spark)}/index-{'stems' if stems else 'words'}-{hashlib.sha1(name.encode()).hexdigest()[:16]}"
    if not exists(spark, f"{path}/totals/_SUCCESS"):
        write(zones(), path, stems)
    return read(spark, path, stems)


def _hits(ix: Index, words: list[str]) -> DataFrame:
    return ix.postings.filter(F.col("term").isin(words)).select("term", "doc_id", "zone", "tf")


def _df(ix: Index, words: list[str]) -> DataFrame:
    """(term, df) of the query's terms: as many rows as it has words."""
    return F.broadcast(ix.vocabulary.filter(F.col("term").isin(words)).select("term", "df"))


def _per_doc(ix: Index, words: list[str]) -> DataFrame:
    return _hits(ix, words).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))


def _total(ix: Index, name: str):
    return ix.totals.select(name).scalar()


def bm25_zone(ix: Index, words: list[str]) -> DataFrame:
    """(doc_id, rel, one column per zone) as ``scoring.bm25_zone``."""
    rows = _hits(ix, words).join(_df(ix, words), "term").join(ix.lengths, ["doc_id", "zone"])
    average = F.coalesce(*[F.when(F.col("zone") == z, _total(ix, f"avg_{z}")) for z in index.ZONES])
    part = rows.withColumn("s", scoring._idf(_total(ix, "docs"), F.col("df")) * scoring._saturated(F.col("tf"), F.col("len"), average))
    zone = {z: F.coalesce(F.sum(F.when(F.col("zone") == z, F.col("s"))), F.lit(0.0)) for z in index.ZONES}
    out = part.groupBy("doc_id").agg(*[c.alias(z) for z, c in zone.items()])
    return out.withColumn("rel", sum((F.col(z) * w for z, w in index.ZONE_WEIGHT.items()), F.lit(0.0)))


def _flat(ix: Index, words: list[str], idf) -> DataFrame:
    q = F.broadcast(scoring._query(ix.postings, words))
    rows = _per_doc(ix, words).join(q, "term").join(_df(ix, words), "term").join(ix.norms.select("doc_id", "len"), "doc_id")
    return rows.groupBy("doc_id").agg(F.sum(F.col("qtf") * idf * scoring._saturated(F.col("tf"), F.col("len"), _total(ix, "avg_len"))).alias("score"))


def bm25_flat(ix: Index, words: list[str]) -> DataFrame:
    """(doc_id, score) as ``scoring.bm25_flat``."""
    return _flat(ix, words, scoring._idf(_total(ix, "docs"), F.col("df")))


def okapi(ix: Index, words: list[str], epsilon: float = 0.25) -> DataFrame:
    """(doc_id, score) as ``scoring.okapi``."""
    idf = F.ln((_total(ix, "docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return _flat(ix, words, F.when(idf < 0, _total(ix, "mean_idf") * epsilon).otherwise(idf))


def lnc_ltc(ix: Index, words: list[str]) -> DataFrame:
    """(doc_id, score) as ``scoring.lnc_ltc``; documents without a token do not count."""
    docs = ix.norms.filter("norm > 0").agg(F.count(F.lit(1)).alias("n")).scalar()
    weight = scoring._query(ix.postings, words).join(_df(ix, words), "term").select("term", ((1 + F.log10("qtf")) * F.log10(docs / F.col("df"))).alias("wq"))
    norm = weight.agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("qnorm"))
    rows = _per_doc(ix, words).join(F.broadcast(weight), "term").join(ix.norms.select("doc_id", "norm"), "doc_id").withColumn("qnorm", norm.scalar())
    return rows.groupBy("doc_id").agg(F.coalesce(F.sum((1 + F.log10("tf")) / F.col("norm") * F.col("wq") / F.nullif("qnorm", F.lit(0.0))), F.lit(0.0)).alias("score"))


def estimate(tree, df: dict[str, int], docs: int) -> int:
    """An upper bound on the documents that match: the rarest part of what must all hold, the sum of alternatives, all of a negation."""
    if isinstance(tree, boolean.Term):
        return df.get(tree.word, 0)
    if isinstance(tree, boolean.Phrase):
        return min(df.get(w, 0) for w in tree.words)
    if isinstance(tree, boolean.Near):
        return min(estimate(tree.left, df, docs), estimate(tree.right, df, docs))
    if isinstance(tree, boolean.And):
        return min((estimate(p, df, docs) for p in tree.parts if not isinstance(p, boolean.Not)), default=docs)
    if isinstance(tree, boolean.Or):
        return min(docs, sum(estimate(p, df, docs) for p in tree.parts))
    return docs


def planned(tree, df: dict[str, int], docs: int):
    """The same query with the parts of each AND from the rarest on, so that later parts meet few documents."""
    if isinstance(tree, (boolean.And, boolean.Or)):
        parts = [planned(p, df, docs) for p in tree.parts]
        if isinstance(tree, boolean.And):
            parts.sort(key=lambda p: estimate(p, df, docs))
        return type(tree)(tuple(parts))
    return boolean.Not(planned(tree.child, df, docs)) if isinstance(tree, boolean.Not) else tree


def statistics(ix: Index, words: list[str]) -> dict[str, tuple[int, int]]:
    """word -> (documents, occurrences) of a query's words, as many as it has."""
    rows = ix.vocabulary.filter(F.col("term").isin(words)).collect()
    return {r["term"]: (r["df"], r["cf"]) for r in rows}


def work(ix: Index, queries: list[str]) -> DataFrame:
    """(query, estimate, postings, positions): the bound on the matches and what answering reads of the index; bags of words are added up."""
    docs = ix.totals.first()["docs"]
    rows = []
    for q in queries:
        try:
            tree = boolean.parse(q, ix.stems)
            words = list(dict.fromkeys(boolean.terms(tree)))
        except ValueError:
            words = list(dict.fromkeys(ix.words(q)))
            tree = boolean.Or(tuple(map(boolean.Term, words)))
        have = statistics(ix, words)
        rows.append((q, estimate(tree, {w: n for w, (n, _) in have.items()}, docs), sum(n for n, _ in have.values()), sum(c for _, c in have.values())))
    return ix.postings.sparkSession.createDataFrame(rows, "query string, estimate long, postings long, positions long")


def candidates(ix: Index, query: str) -> tuple[DataFrame, list[str]]:
    """(documents, terms to score) of a query, the rarest parts first; one that cannot be parsed is a bag of words."""
    try:
        tree = boolean.parse(query, ix.stems)
    except ValueError:
        return boolean.candidates(query, ix.positions, ix.norms, ix.stems)
    words = list(dict.fromkeys(boolean.terms(tree)))
    if "And(" in repr(tree):
        df = {w: n for w, (n, _) in statistics(ix, words).items()}
        tree = planned(tree, df, ix.totals.first()["docs"])
    return boolean.evaluate(tree, ix.positions, ix.norms), words


def search(ix: Index, query: str, k: int) -> DataFrame:
    """(doc_id, rel): the k best documents of a parsed query; negated words score too."""
    docs, words = candidates(ix, query)
    scored = docs.join(bm25_zone(ix, words), "doc_id", "left").select("doc_id", F.coalesce("rel", F.lit(0.0)).alias("rel"))
    return scoring.top_k(scored, k, "rel")
