"""Evaluation passages inside a training corpus: Wu-Manber multi-pattern search.

The patterns are the five-word runs of all test items.  A block is a pair of
words; the shift table tells for each block how far the window may move on
without passing a pattern's end, so blocks that no pattern holds skip four
words at once.  Where the shift is zero the block's suffix-hash bucket names
the candidate patterns, and comparing their leading words confirms.  For each
document and item the confirmed runs are aligned and measured.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a pattern, and of a block.
RUN, BLOCK = 5, 2
#: Share of an item's words a document must reproduce, in order and in passages of PASSAGE words or more.
SHARE, PASSAGE = 0.4, 12
#: Share of an item's words that must lie in exactly reproduced five-word runs.
EXACT = 0.2
#: Differing words that a passage may hold between two matching stretches, on either side.
GAP = 4
#: Words of items searched for in one pass; more items are searched in blocks.
PASS_WORDS = 2_000_000

_HYPHEN = re.compile(r"(\w)[-­‐‑]\s*\n\s*(?:[>|#*]+[ \t]*)?(\w)")
_WORD = re.compile(r"[^\W_]+")
# Cyrillic and Greek letters that look like Latin ones.
_LOOKALIKE = str.maketrans("авекмнорстухіјѕԁһԛԝοαενικρτυχ", "abekmhopctyxijsdhqwoaevikptux")
_SUPERFLUOUS = re.compile("[­​-‏⁠﻿]")


def words(text: str) -> list[str]:
    """Lower-case words without case, width, look-alike letters, zero-width characters, punctuation and line layout."""
    text = _SUPERFLUOUS.sub("", unicodedata.normalize("NFKC", _HYPHEN.sub(r"\1\2", text)))
    return [_latin(w) for w in _WORD.findall(text.lower())]


def _latin(word: str) -> str:
    if word.isascii():
        return word
    swapped = word.translate(_LOOKALIKE)
    return swapped if swapped.isascii() else word


class WuManber:
    """Shift table and suffix buckets of word runs; ``find`` yields (end position, postings)."""

    def __init__(self, items: Iterable[tuple[int, list[str]]]) -> None:
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], dict[tuple[str, ...], list[tuple[int, int]]]] = {}
        for item, w in items:
            for at in range(len(w) - RUN + 1):
                run = w[at : at + RUN]
                for end in range(BLOCK - 1, RUN):
                    block = (run[end - 1], run[end])
                    self.shift[block] = min(self.shift.get(block, RUN), RUN - 1 - end)
                self.bucket.setdefault((run[-2], run[-1]), {}).setdefault(tuple(run[:-BLOCK]), []).append((item, at))

    def find(self, w: list[str]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        at, skip, shift = RUN - 1, RUN - BLOCK + 1, self.shift
        while at < len(w):
            block = (w[at - 1], w[at])
            step = shift.get(block, skip)
            if step == 0:
                hit = self.bucket[block].get(tuple(w[at - RUN + 1 : at - BLOCK + 1]))
                if hit:
                    yield at - RUN + 1, hit
                step = 1
            at += step


def _reproduced(doc: list[str], item: list[str], hits: list[tuple[int, int]]) -> float:
    """Share of the item's words that the document has in order in long passages."""
    exact = {p + k for _, p in hits for k in range(RUN)}
    if len(exact) < EXACT * len(item):
        return 0.0
    # Only the document's surroundings of the hits are aligned; distant stretches are joined by a mark that matches nothing.
    near: list[str | None] = []
    end = 0
    for d in sorted({d for d, _ in hits}):
        lo, hi = max(end, d - 3 * RUN), min(len(doc), d + 4 * RUN)
        if lo > end and near:
            near.append(None)
        near += doc[lo:hi]
        end = max(end, hi)
    blocks = [b for b in difflib.SequenceMatcher(None, near, item, autojunk=False).get_matching_blocks() if b.size > 1]
    total = n = 0
    last = None
    for b in [*blocks, None]:
        if b and last and b.a - last.a - last.size <= GAP and b.b - last.b - last.size <= GAP:
            n += b.size
        else:
            total += n if n >= PASSAGE else 0
            n = b.size if b else 0
        last = b
    return total / len(item)


_automata: dict[str, tuple[dict[int, list[str]], WuManber]] = {}


def _automaton(name: str, block) -> tuple[dict[int, list[str]], WuManber]:
    """A block's items and automaton, built once by a worker and kept until it turns to another block."""
    if name not in _automata:
        _automata.clear()
        items = block.value
        _automata[name] = items, WuManber(items.items())
    return _automata[name]


def leaked_pairs(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, pass_words: int = PASS_WORDS) -> DataFrame:
    """(doc_id, item_id, share): documents that reproduce at least two fifths of an item's words.

    The items are the stated query set: they are searched for in every whole
    document, in blocks of at most ``pass_words`` words (the bound of what is
    sent to a worker at once), in one narrow pass per block without a shuffle of
    the corpus.  NULL or empty texts and ids match
    nothing; items under five words are no passages; repeated rows give one
    row.  Columns of other names are ignored.
    """
    rows = items.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).distinct()
    context = docs.sparkSession.sparkContext
    blocks = []
    block: dict[int, list[str]] = {}
    size = 0
    # Items come one partition at a time and leave the driver's memory with their block.
    for r in rows.toLocalIterator():
        w = words(r["t"])
        if size + len(w) > pass_words and block:
            blocks.append((uuid.uuid4().hex, context.broadcast(block)))
            block, size = {}, 0
        block[r["i"]] = w
        size += len(w)
    blocks.append((uuid.uuid4().hex, context.broadcast(block)))
    kinds = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, share double"
    base = docs.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    found = None
    for name, sent in blocks:

        def search(batches: Iterator[pd.DataFrame], name=name, sent=sent) -> Iterator[pd.DataFrame]:
            block, automaton = _automaton(name, sent)
            for b in batches:
                out = []
                for d, t in zip(b["d"], b["t"]):
                    w = words(t)
                    hits: dict[int, list[tuple[int, int]]] = {}
                    for at, postings in automaton.find(w):
                        for item, p in postings:
                            hits.setdefault(item, []).append((at, p))
                    for item, h in hits.items():
                        share = _reproduced(w, block[item], h)
                        if share >= SHARE:
                            out.append((d, item, share))
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "share"])

        part = base.mapInPandas(search, kinds)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def leak_report(pairs: DataFrame, items: DataFrame, item_id: str) -> DataFrame:
    """(item_id, leaked, documents, largest_share) for every item."""
    per_item = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("share").alias("largest_share"))
    every = items.select(F.col(item_id).alias("item_id")).filter(F.col("item_id").isNotNull()).distinct()
    return every.join(per_item, "item_id", "left").select("item_id", F.col("documents").isNotNull().alias("leaked"), F.coalesce("documents", F.lit(0)).alias("documents"), "largest_share")
