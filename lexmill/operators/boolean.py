"""Boolean, phrase and proximity queries: a parser, and a compiler from its tree to DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.stem import stem_token
from lexmill.functions.text import LEGAL, LEGAL_NUMBER, STOP, TOKEN

_LEX = re.compile(r'"[^"]*"|/\w+|[()]|[^\s()]+')
#: What /s and /p stand for.
NEAR = 5
#: Nesting deeper than this is malformed.
DEPTH = 100


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


@dataclass(frozen=True)
class Near:
    left: object
    right: object
    reach: int


@dataclass(frozen=True)
class Not:
    child: object


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


def query_tokens(text: str, stems: bool = False) -> list[str]:
    """Tokens of a query's text, spelled as in the index and stemmed if it is."""
    t = re.sub(r"\[(\d{4})\]", r"\1", text)
    for dotted, plain in ((r"\bS\.C\.R\.", "SCR"), (r"\bS\.C\.C\.", "SCC"), (r"\bI\.N\.S\.C\.", "INSC"), (r"\bCr\.\s*P\.?\s*C\.", "CrPC")):
        t = re.sub(dotted, plain, t, flags=re.I)
    found = [w for w in re.findall(TOKEN, t.lower()) if w in LEGAL or re.match(LEGAL_NUMBER, w) or w not in STOP]
    return [stem_token(w) for w in found] if stems else found


class Parser:
    """Precedence, loosest first: OR, AND, NOT, proximity; adjacent words without an operator are malformed."""

    def __init__(self, query: str, stems: bool = False) -> None:
        self.stems = stems
        self.items = _LEX.findall(query or "")
        self.at = 0
        self.depth = 0

    def parse(self):
        if not self.items:
            raise ValueError("empty query")
        tree = self._or()
        if self.at < len(self.items):
            raise ValueError(f"unexpected {self.items[self.at]!r}")
        return tree

    def _peek(self) -> str:
        return self.items[self.at] if self.at < len(self.items) else ""

    def _next(self) -> str:
        if self.at >= len(self.items):
            raise ValueError("the query ends too early")
        self.at += 1
        return self.items[self.at - 1]

    def _chain(self, operand, word: str, node):
        parts = [operand()]
        while self._peek().upper() == word:
            self._next()
            parts.append(operand())
        return parts[0] if len(parts) == 1 else node(tuple(parts))

    def _or(self):
        self.depth += 1
        if self.depth > DEPTH:
            raise ValueError("nested too deeply")
        tree = self._chain(self._and, "OR", Or)
        self.depth -= 1
        return tree

    def _and(self):
        return self._chain(self._not, "AND", And)

    def _not(self):
        negated = False
        while self._peek().upper() == "NOT":
            self._next()
            negated = not negated
        tree = self._near()
        return Not(tree) if negated else tree

    def _near(self):
        tree = self._atom()
        while re.fullmatch(r"/(?:\d+|[sp])", self._peek().lower()):
            op = self._next().lower()
            tree = Near(tree, self._atom(), int(op[1:]) if op[1:].isdigit() else NEAR)
        return tree

    def _atom(self):
        item = self._next()
        if item.upper() in ("AND", "OR", "NOT") or item == ")" or (item.startswith("/") and len(item) > 1):
            raise ValueError(f"unexpected {item!r}")
        if item == "(":
            tree = self._or()
            if self._next() != ")":
                raise ValueError("missing )")
            return tree
        if len(item) > 1 and item[0] == item[-1] == '"':
            words = query_tokens(item[1:-1], self.stems) or item[1:-1].lower().split()
            if not words:
                raise ValueError("empty phrase")
            return Phrase(tuple(words))
        words = query_tokens(item, self.stems) or [re.sub(r"[^\w-]", "", item.lower())]
        if not words[0]:
            raise ValueError(f"no term in {item!r}")
        return Term(words[0])


def parse(query: str, stems: bool = False):
    return Parser(query, stems).parse()


def terms(tree) -> list[str]:
    """All terms from left to right, negated ones included."""
    if isinstance(tree, Term):
        return [tree.word]
    if isinstance(tree, Phrase):
        return list(tree.words)
    if isinstance(tree, Near):
        return terms(tree.left) + terms(tree.right)
    if isinstance(tree, Not):
        return terms(tree.child)
    return [w for p in tree.parts for w in terms(p)]


def phrase_starts(pos: DataFrame, words: tuple[str, ...], per_zone: bool = False) -> DataFrame:
    """(doc_id[, zone], start) of a phrase: each word's position less its place in the phrase is the same start."""
    place = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(words)]))
    by = ["doc_id", "zone", "start"] if per_zone else ["doc_id", "start"]
    hit = pos.filter(F.col("term").isin(list(words))).select("*", place.alias("p")).filter(F.col("p.w") == F.col("term"))
    return hit.withColumn("start", F.col("pos") - F.col("p.i")).groupBy(*by).agg(F.countDistinct("p.i").alias("n")).filter(F.col("n") == len(words)).drop("n")


def near_docs(left: DataFrame, right: DataFrame, reach: int) -> DataFrame:
    """Documents with a left and a right position at most ``reach`` apart.

    A band join by buckets: both sides meet on (document, bucket of ``reach``
    positions), the right side in its own bucket and both neighbours, so no
    document's positions are paired as a whole.
    """
    width = max(1, reach)
    a = left.select("doc_id", F.col("pos").alias("l"), F.floor(F.col("pos") / width).alias("b"))
    b = right.select("doc_id", F.col("pos").alias("r"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("pos") / width) + k)).alias("b"))
    return a.join(b, ["doc_id", "b"]).filter(F.abs(F.col("l") - F.col("r")) <= reach).select("doc_id").distinct()


def evaluate(tree, pos: DataFrame, docs: DataFrame) -> DataFrame:
    """Matching doc_ids: AND as semi and anti joins, OR as a union, NOT against all documents."""
    if isinstance(tree, Term):
        return pos.filter(F.col("term") == tree.word).select("doc_id").distinct()
    if isinstance(tree, Phrase):
        return phrase_starts(pos, tree.words).select("doc_id").distinct()
    if isinstance(tree, Near):
        sides = [pos.filter(F.col("term").isin(terms(t))).select("doc_id", "pos") for t in (tree.left, tree.right)]
        out = near_docs(*sides, tree.reach)
        for t in (tree.left, tree.right):
            if not isinstance(t, Term):
                out = out.join(evaluate(t, pos, docs), "doc_id", "left_semi")
        return out
    if isinstance(tree, Not):
        return docs.select("doc_id").distinct().join(evaluate(tree.child, pos, docs), "doc_id", "left_anti")
    if isinstance(tree, Or):
        out = evaluate(tree.parts[0], pos, docs)
        for p in tree.parts[1:]:
            out = out.union(evaluate(p, pos, docs))
        return out.distinct()
    wanted = [p for p in tree.parts if not isinstance(p, Not)]
    out = evaluate(wanted[0], pos, docs) if wanted else docs.select("doc_id").distinct()
    for p in wanted[1:]:
        out = out.join(evaluate(p, pos, docs), "doc_id", "left_semi")
    for p in tree.parts:
        if isinstance(p, Not):
            out = out.join(evaluate(p.child, pos, docs), "doc_id", "left_anti")
    return out


def evaluate_one_by_one(tree, pos: DataFrame, docs: DataFrame) -> DataFrame:
    """The same by plain set operations from left to right: a second plan to check the first against."""
    if isinstance(tree, And):
        out = evaluate_one_by_one(tree.parts[0], pos, docs)
        for p in tree.parts[1:]:
            out = out.intersect(evaluate_one_by_one(p, pos, docs))
        return out
    if isinstance(tree, Or):
        out = evaluate_one_by_one(tree.parts[0], pos, docs)
        for p in tree.parts[1:]:
            out = out.union(evaluate_one_by_one(p, pos, docs))
        return out.distinct()
    if isinstance(tree, Not):
        return docs.select("doc_id").distinct().exceptAll(evaluate_one_by_one(tree.child, pos, docs))
    return evaluate(tree, pos, docs)


def candidates(query: str, pos: DataFrame, docs: DataFrame, stems: bool = False) -> tuple[DataFrame, list[str]]:
    """(documents, terms to score); a query that cannot be parsed is a bag of words."""
    try:
        tree = parse(query, stems)
    except ValueError:
        words = list(dict.fromkeys(query_tokens(query, stems)))
        return pos.filter(F.col("term").isin(words)).select("doc_id").distinct(), words
    return evaluate(tree, pos, docs), list(dict.fromkeys(terms(tree)))


def filtered(docs: DataFrame, **wanted) -> DataFrame:
    """Documents by metadata; a NULL is asked for with None."""
    for column, value in wanted.items():
        if column in docs.columns:
            docs = docs.filter(F.col(column).eqNullSafe(F.lit(value)))
    return docs
