"""Whether a collection can answer stated queries at all: counts of documents, and a verdict from the counts alone."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import TOKEN
from lexmill.operators import boolean, stored

#: At most so many documents make a query thin; telling words of a query that are looked for.
THIN, MOST_TERMS = 3, 6
# What leads to a section's number in running text, and numbers listed before it.
_LEAD, _MORE = r"(?:sections?|secs?\.?|s\.|u/s\.?)\s*", r"(?:\d+[A-Za-z]?(?:\(\d+\))*\s*(?:,|and|&|/|to|-)\s*)*"


def content_terms(query: str) -> list[str]:
    """The first telling words of a query, each once; connectives and numbers are none."""
    words = boolean.query_tokens(re.sub(r"\b(?:AND|OR|NOT)\b|/\w+", " ", query))
    return list(dict.fromkeys(w for w in words if not w[0].isdigit()))[:MOST_TERMS]


def section_numbers(query: str) -> list[str]:
    return list(dict.fromkeys(m for m in re.findall(TOKEN, query.lower()) if re.fullmatch(r"[0-9]{1,4}[a-z]?", m)))


def section_counts(texts: DataFrame, numbers: list[str]) -> DataFrame:
    """(section, documents) for every number asked for, 0 included: documents whose text names it as a section; one pass."""
    named = lambda n: F.col("text").rlike(rf"(?i)(?<![A-Za-z0-9]){_LEAD}{_MORE}{re.escape(n)}(?![A-Za-z0-9])")
    row = texts.agg(*[F.count_if(named(n)).alias(f"c{i}") for i, n in enumerate(numbers)] or [F.lit(0)])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("section"), F.col(f"c{i}").alias("documents")) for i, n in enumerate(numbers)]).cast("array<struct<section:string,documents:bigint>>"))
    return row.select(each.alias("s")).select("s.*")


def feasibility(ix: stored.Index, texts: DataFrame, queries: Iterable[tuple[str, str]]) -> DataFrame:
    """(qid, candidates, all_terms, section, documents, verdict): a row per query and section it names (one without, if none).

    ``candidates``: documents the query matches as written; ``all_terms``: those
    that hold every telling word, NULL without any.  ``empty`` if one of the
    counts is 0, ``thin`` if one is at most THIN, else ``ok``.  The queries are
    a stated list; each is answered from the stored index.
    """
    spark = ix.postings.sparkSession
    queries = list(queries)
    asked = {qid: section_numbers(text) for qid, text in queries}
    parts = []
    for qid, text in queries:
        words = [w for t in content_terms(text) for w in ix.words(t)]
        both = boolean.evaluate(boolean.And(tuple(map(boolean.Term, words))), ix.positions, ix.norms) if words else None
        found = stored.candidates(ix, text)[0].agg(F.count(F.lit(1)).alias("candidates"))
        every = both.agg(F.count(F.lit(1))).scalar() if both is not None else F.lit(None).cast("long")
        parts.append(found.select(F.lit(qid).alias("qid"), "candidates", every.alias("all_terms")))
    counts = reduce(DataFrame.unionByName, parts)
    sections = section_counts(texts, sorted({n for ns in asked.values() for n in ns}))
    wants = spark.createDataFrame([(q, n) for q, ns in asked.items() for n in ns or [None]], "qid string, section string")
    table = counts.join(F.broadcast(wants), "qid").join(F.broadcast(sections), "section", "left")
    least = F.min(F.least(F.col("candidates"), F.col("all_terms"), F.col("documents"))).over(stored.Window.partitionBy("qid"))
    thin = F.min(F.least(F.col("all_terms"), F.col("documents"))).over(stored.Window.partitionBy("qid"))
    verdict = F.when(least == 0, "empty").when(thin <= THIN, "thin").otherwise("ok")
    return table.select("qid", "candidates", "all_terms", "section", "documents", verdict.alias("verdict"))
