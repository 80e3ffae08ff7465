"""Occurrences and record counts of every term: burst-trie counting.

Each worker counts the terms of its records in a burst trie: terms are routed
by a prefix, a container holds the suffixes under one prefix with their
counters, and a container that grows past a limit bursts into one container
per next character, so the prefixes adapt to the vocabulary.  Containers leave
the worker as compact sorted, front-coded bytes.  The prefixes' sizes over all
workers decide the shuffle routes, containers are cut along them, and the
matching subtrees of all workers are merged route by route.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import materialise

#: A term is a maximal run of letters, marks and numbers.
TERM = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: Suffixes a worker's container may hold before it bursts.
BURST = 512
#: Terms a worker keeps before it hands its trie on and begins another.
KEEP = 200_000
#: Terms (summed over workers) one merging route may hold.
ROUTE_TERMS = 20_000
#: Prefixes longer than this are not cut further; the terms below them are few and share one route.
MAX_PREFIX = 24


class BurstTrie:
    """prefix -> {suffix: [occurrences, records]}; the prefixes in ``inner`` have burst."""

    def __init__(self, burst: int = BURST) -> None:
        self.burst = burst
        self.inner: set[str] = {""}
        self.leaves: dict[str, dict[str, list[int]]] = {}
        self.n = 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        d = 0
        while term[:d] in self.inner and d < len(term):
            d += 1
        prefix, suffix = term[:d], term[d:]
        leaf = self.leaves.setdefault(prefix, {})
        c = leaf.get(suffix)
        if c is None:
            leaf[suffix] = [occurrences, records]
            self.n += 1
            if len(leaf) > self.burst and d < MAX_PREFIX:
                self._burst(prefix)
        else:
            c[0] += occurrences
            c[1] += records

    def _burst(self, prefix: str) -> None:
        self.inner.add(prefix)
        for suffix, c in self.leaves.pop(prefix).items():
            # The term that ends here keeps a container of its own under the same prefix.
            self.leaves.setdefault(prefix + suffix[:1], {})[suffix[1:]] = c
        for child in [p for p in self.leaves if len(p) == len(prefix) + 1 and p.startswith(prefix) and len(self.leaves[p]) > self.burst]:
            if len(child) < MAX_PREFIX:
                self._burst(child)

    def containers(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        yield from self.leaves.items()


def _varint(n: int, out: bytearray) -> None:
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def pack(leaf: Mapping[str, Iterable[int]]) -> bytes:
    """A container as bytes: sorted suffixes, each as shared prefix length, rest length, rest, two counters."""
    out, last = bytearray(), b""
    for suffix, (occurrences, records) in sorted((s.encode(), c) for s, c in leaf.items()):
        k = 0
        while k < min(len(last), len(suffix)) and last[k] == suffix[k]:
            k += 1
        for n in (k, len(suffix) - k):
            _varint(n, out)
        out += suffix[k:]
        _varint(occurrences, out)
        _varint(records, out)
        last = suffix
    return bytes(out)


def unpack(data: bytes) -> Iterator[tuple[str, int, int]]:
    at, last = 0, b""

    def read() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(data):
        k, rest = read(), read()
        last = last[:k] + data[at : at + rest]
        at += rest
        yield last.decode(), read(), read()


def _emit(tries: dict[str, BurstTrie]) -> pd.DataFrame:
    rows = [(field, prefix, len(leaf), pack(leaf)) for field, t in tries.items() for prefix, leaf in t.containers()]
    return pd.DataFrame(rows, columns=["field", "prefix", "n", "data"])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tries: dict[str, BurstTrie] = {}
    for b in batches:
        for field, part in b.groupby("field", sort=False):
            trie = tries.setdefault(field, BurstTrie())
            occurrences: Counter[str] = Counter()
            records: Counter[str] = Counter()
            for text in part["value"]:
                if text:
                    found = TERM.findall(text.lower())
                    occurrences.update(found)
                    records.update(set(found))
            for term, n in occurrences.items():
                trie.add(term, n, records[term])
        if sum(t.n for t in tries.values()) > KEEP:
            yield _emit(tries)
            tries = {}
    if tries:
        yield _emit(tries)


def term_counts(df: DataFrame, record: str, fields: Mapping[str, str], route_terms: int = ROUTE_TERMS) -> DataFrame:
    """(field, term, occurrences, records) for each ``fields`` entry (field name -> column).

    Rows of one record are taken to carry the same content and count once (of
    different ones the smallest text is counted); rows with a NULL record id
    are left out.  NULL and empty texts hold no terms.  Terms are those of the
    lower-cased text.  No rows give no rows; other columns are ignored.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in fields.items()]))
    once = df.filter(F.col(record).isNotNull()).select(F.col(record).cast("string").alias("record"), pairs.alias("x")).groupBy("record", F.col("x.field").alias("field")).agg(F.min("x.value").alias("value"))
    tries = materialise(once.select("field", "value").mapInPandas(_count, "field string, prefix string, n long, data binary"), "tries")
    return merge_tries(tries, route_terms)


def merge_tries(tries: DataFrame, route_terms: int = ROUTE_TERMS) -> DataFrame:
    """Merge workers' containers (field, prefix, n, data) into one row per term."""
    # Sizes of all prefixes over all workers; those too large for one route are burst.  Their
    # number is at most MAX_PREFIX * (all terms of all workers) / limit, so with the limit raised
    # for large inputs it stays under MAX_PREFIX * 4096 and the set may go to every worker.
    total = tries.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(route_terms, total // 4096)
    sizes = (
        tries.select("field", "n", F.explode(F.transform(F.sequence(F.lit(0), F.length("prefix")), lambda i: F.substring("prefix", F.lit(1), i))).alias("p"))
        .groupBy("field", "p")
        .agg(F.sum("n").alias("n"))
        .filter((F.col("n") > limit) & (F.length("p") < MAX_PREFIX))
    )
    inner = {(r["field"], r["p"]) for r in sizes.select("field", "p").collect()}

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for field, prefix, n, data in zip(b["field"], b["prefix"], b["n"], b["data"]):
                d = 0
                while d < len(prefix) and (field, prefix[:d]) in inner:
                    d += 1
                if (field, prefix[:d]) not in inner:
                    out.append((field, prefix[:d], pack({prefix[d:] + s: c for s, *c in unpack(data)}) if d < len(prefix) else data))
                    continue
                cut: dict[str, dict[str, list[int]]] = {}
                for s, *c in unpack(data):
                    term, k = prefix + s, d
                    while k < len(term) and (field, term[:k]) in inner:
                        k += 1
                    cut.setdefault(term[:k], {})[term[k:]] = c
                out.extend((field, p, pack(leaf)) for p, leaf in cut.items())
            yield pd.DataFrame(out, columns=["field", "route", "data"])

    def merge(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field, prefix = key
        trie = BurstTrie()
        for b in batches:
            for data in b["data"]:
                for s, n, r in unpack(data):
                    trie.add(s, n, r)
        rows = [(field, prefix + p + s, c[0], c[1]) for p, leaf in trie.containers() for s, c in leaf.items()]
        yield pd.DataFrame(rows, columns=["field", "term", "occurrences", "records"])

    routed = tries.select("field", "prefix", "n", "data").mapInPandas(route, "field string, route string, data binary")
    return routed.groupBy("field", "route").applyInPandas(merge, "field string, term string, occurrences long, records long")


def banded(counts: DataFrame, totals: Mapping[str, int], rare_below: int = 3, common_above: float = 0.3) -> DataFrame:
    """Mark terms of ``counts``: ``rare`` in fewer than ``rare_below`` records, ``common`` in more than that share, else NULL.

    ``totals`` gives each field's number of records.  A term of a very small table that is both is ``rare``.
    """
    many = F.coalesce(*[F.when(F.col("field") == f, F.col("records") > F.lit(common_above) * n) for f, n in totals.items()])
    return counts.withColumn("band", F.when(F.col("records") < rare_below, F.lit("rare")).when(many, F.lit("common")))
