"""Texts cut off by field limits.

Every text's length is recomputed under the encodings and escapings a field may
have been measured in.  Grouped by source, a length at which many texts pile up
and beyond which almost none goes is a hidden storage limit.  Then the endings
are inspected: marks of a cut, words and sentences without an end, open
quotations, and whether the corpus ends sentences with these words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexmill.session import materialise


def _json(t: str) -> int:
    return len(t) + sum(t.count(c) for c in '"\\\n\r\t')


#: How a field may have been measured: name -> length.
MEASURES: dict[str, Callable[[str], int]] = {
    "chars": len,
    "utf8": lambda t: len(t.encode("utf-8", "surrogatepass")),
    "utf16": lambda t: len(t) + sum(c > "￿" for c in t) if not t.isascii() else len(t),
    "html": lambda t: len(t) + 4 * t.count("&") + 3 * (t.count("<") + t.count(">")) + 5 * (t.count('"') + t.count("'")),
    "html_text": lambda t: len(t) + 4 * t.count("&") + 3 * (t.count("<") + t.count(">")),
    "html_utf8": lambda t: len(t.encode("utf-8", "surrogatepass")) + 4 * t.count("&") + 3 * (t.count("<") + t.count(">")) + 5 * (t.count('"') + t.count("'")),
    "json": _json,
    "json_ascii": lambda t: _json(t) + 5 * sum(not c.isascii() for c in t) if not t.isascii() else _json(t),
    "crlf": lambda t: len(t) + t.count("\n"),
    "crlf_utf8": lambda t: len(t.encode("utf-8", "surrogatepass")) + t.count("\n"),
}
#: The same with a mark of the cut at the end taken off.
NAMES = [*MEASURES, *(f"{m}_unmarked" for m in MEASURES)]
#: Lengths below a limit that still count as lying at it: a character or escape that did not fit whole.
SLACK = 3
#: A limit needs this many texts at it and this share of its source; texts beyond it must be fewer than this part of those at it.
LEAST, LEAST_SHARE, BEYOND = 3, 0.01, 0.1
#: Where cuts move back to the end of a word: lengths below a limit that still count, texts needed there, how many times denser they must be than below. Lengths of whole texts are preferred to those without marks if their pile is this part of the other.
WORD, LEAST_BAND, DENSER, MOST = 20, 10, 3, 2 / 3
#: A closing line is a formula if this share of all documents ends with one of its shape.
FORMULA_SHARE = 0.0015
#: An ending ends a sentence if at least this share of its occurrences elsewhere does.
ENDS = 0.5
#: A source leaves its last end mark out by habit if this share of its open endings (formulas and texts at the limit apart) end sentences.
HABIT = 0.25

def _at_end(pattern: str, flags: int = 0) -> regex.Pattern:
    """A pattern to be matched backwards from the end of a text, whole and without a look at what lies far before."""
    return regex.compile(f"(?r)(?:{pattern})", flags)


_CLOSERS = "\"'”’»)]」』）"
_END = _at_end(rf"(?:[.?!।॥۔؟。！？…]|[ऀ-ॿ]\s?\|)[{re.escape(_CLOSERS)}\s]*")
#: Remains of an escape sequence, an entity, a tag or a character cut in the middle, and marks that a system sets at its cut.
_REMAINS = _at_end(r"(?:�|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|\\|&#?\w{0,7})")
_TAG = re.compile(r"</?[A-Za-z]*(?:\s[^<>]*)?")
_MARKED = _at_end(r"(?:\[\s?(?:\.\.\.|…|more|truncated|cut)\s?\]|\((?:more|contd\.?|continued|truncated|cut)\)|(?:read|see) more|\w(?:…|\.\.\.)|[^.?!\s]\s?…)\s*", regex.I)
_MARK = _at_end(r"\s*(?:\[\s?(?:\.\.\.|…|more|truncated|cut)\s?\]|\((?:more|contd\.?|continued|truncated|cut)\)|\b(?:read|see) more|…|\.\.\.)\s*", regex.I)
# Abbreviations that stand before more text and so end no sentence.
_ABBREVIATION = _at_end(
    r"(?:^|[\s(\"“])(?:Mr|Mrs|Ms|Smt|Dr|Shri|Messrs|M/s|Sr|Hon|Ex|No|Nos|no|Rs|s|ss|sub-s|cl|para|paras|Art|Arts|Crl|Supp|S\.C\.C|A\.I\.R|S\.C|v|vs|Vs|p|pp|viz|i\.e|e\.g|w\.e\.f|P\.W|D\.W|"
    r"Sec|Cr|Vol|r|rr|St|[A-Z](?:\.[A-Z])?|रु|नं|डॉ|श्री|ரூ|எண்|திரு)\."
)
_SIGNED = _at_end(r"\)\s*\n\s*[A-Z]{1,3}\.?")
_OPEN_NUMBER = _at_end(r"(?:Rs\.|रु\.|ரூ\.)\s?[\d,]+\.|\b\d{1,2}\.\d{1,2}\.|(?:^|\n)\s*\d{1,3}\.")
_STOPS = tuple(".?!।॥۔؟。！？|")
_WORD = re.compile(r"[^\W\d_]+(?:[-'][^\W\d_]+)*|\d+|[一-鿿]")
_BREAK_RULE = r"(?<=[.?!।॥۔؟。！？|])[\"'”’)\]]*\s+|(?<=[。！？])[”’」]?|\n"
_BREAK = re.compile(_BREAK_RULE)
_LAST_BREAK = regex.compile(f"(?r){_BREAK_RULE}")


def _unclosed(text: str) -> bool:
    """Whether the last paragraph opens a quotation or bracket that it does not close."""
    last = text[text.rfind("\n") + 1 :]
    if last.count('"') % 2 or last.count("“") > last.count("”") or last.count("「") > last.count("」"):
        return True
    return last.rfind("(") > last.rfind(")") or last.rfind("[") > last.rfind("]")


def tail_key(text: str) -> str | None:
    """The last two words, lower-case, with names and numbers masked; the last four characters in scripts without spaces."""
    text = text.rstrip()
    m = _LAST_BREAK.search(text)
    found = _WORD.findall(text, m.end() if m else 0)
    if not found or (len(found) < 2 and not "一" <= found[-1] <= "鿿"):
        return None
    if "一" <= found[-1] <= "鿿":
        return "".join(found[-4:])
    return _FORMS[found[-2]][0] + _FORMS[found[-1]][1]


class _Forms(dict):
    """Word -> (its form before another, its form behind another), names and numbers masked; emptied when it grows."""

    def __missing__(self, word: str) -> tuple[str, str]:
        if len(self) > 200_000:
            self.clear()
        digit = word[0].isdigit()
        self[word] = out = ("9 " if digit else f"{word.lower()} ", "9" if digit else "W" if word[0].isupper() else word.lower())
        return out


_FORMS = _Forms()


def line_shape(text: str) -> str | None:
    """The form of a short last line that stands by itself."""
    at = text.rstrip().rfind("\n")
    line = text.rstrip()[at + 1 :].strip()
    if at < 0 or not 0 < len(line) <= 80:
        return None
    shape = re.sub(r"\d+", "9", line)
    if re.search(r"[:;]", line):
        shape = re.sub(r"[^\W\d_]+", lambda m: "W" if m[0][0].isupper() else "w", shape)
        shape = re.sub(r"(?:[Ww]\.)+", "W.", shape)
    return shape


def ending(text: str) -> str:
    """``marked`` or ``broken`` (cut), ``closed`` (complete), or ``open``: no end mark, to be decided by limit and corpus."""
    t = text.rstrip()
    if not t:
        return "closed"
    if _REMAINS.match(t) or (at := t.rfind("<")) >= 0 and _TAG.fullmatch(t, at) or (_MARKED.match(t) and not t.endswith((" ...", " …"))):
        return "marked"
    if _signature(t):
        return "closed"
    if _END.match(t):
        core = t.rstrip(_CLOSERS + " ")
        if t.endswith((" ...", " …")):
            return "open"
        if _unclosed(t) or (core.endswith(".") and (_OPEN_NUMBER.match(core[-30:]) or _ABBREVIATION.match(core[-30:]))):
            return "broken"
        return "closed"
    return "open"


def _signature(text: str) -> bool:
    """A judge's signature closes a text: the name in brackets on a line, the office in capitals on the last."""
    return _SIGNED.match(text) is not None


def lengths(text: str) -> list[int]:
    """The text's length under every one of NAMES."""
    whole = [f(text) for f in MEASURES.values()]
    m = _MARK.match(text)
    return whole + ([f(text[: len(text) - len(m[0])]) for f in MEASURES.values()] if m else whole)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = b.pop("text")
        b["lengths"] = [lengths(t) for t in texts]
        b["ending"] = [ending(t) for t in texts]
        b["tail"] = [tail_key(t) for t in texts]
        b["shape"] = [line_shape(t) for t in texts]
        yield b


def _tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each two-word ending occurs and how often it ends a sentence, added up per worker.

    Words are counted in pairs as they stand; names and numbers are masked once per distinct pair."""
    every: Counter[tuple[str, ...]] = Counter()
    ends: Counter[tuple[str, ...]] = Counter()

    def out() -> pd.DataFrame:
        rows = [("".join(k) if len(k) > 2 else _FORMS[k[0]][0] + _FORMS[k[1]][1], n, ends[k]) for k, n in every.items()]
        return pd.DataFrame(rows, columns=["tail", "n", "n_end"])

    for b in batches:
        for text in b["text"]:
            for s in _BREAK.split(text):
                w = _WORD.findall(s)
                if len(w) < 2:
                    continue
                keys = list(zip(w, w[1:], w[2:], w[3:]) if "一" <= w[-1] <= "鿿" else zip(w, w[1:]))
                every.update(keys)
                end = s.rstrip(_CLOSERS + " ")
                if keys and end[-1:] in _STOPS and not _ABBREVIATION.match(end):
                    ends[keys[-1]] += 1
        if len(every) > 200_000:
            yield out()
            every, ends = Counter(), Counter()
    yield out()


def hidden_limits(features: DataFrame) -> DataFrame:
    """(source, measure, field_limit, at, width): the limit of each source that has one.

    Per source and measure the lengths are counted (rows are source x length,
    not documents); the limit is the largest pile at a length beyond which
    fewer than a tenth as many texts go, so a source has one.  Cuts moved back to the end of a word
    pile up over a band (``width``) below the limit instead of at one length.
    """
    pairs = F.arrays_zip(F.array(*map(F.lit, NAMES)).alias("measure"), F.col("lengths").alias("length"))
    counts = features.select("source", F.explode(pairs).alias("x")).groupBy("source", F.col("x.measure").alias("measure"), F.col("x.length").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("source", "measure")
    up = by.orderBy("length")
    size = WORD + 1
    seen = (
        counts.withColumn("at", F.sum("n").over(up.rangeBetween(-SLACK, 0)))
        .withColumn("past", F.coalesce(F.sum("n").over(up.rangeBetween(1, Window.unboundedFollowing)), F.lit(0)))
        .withColumn("all", F.sum("n").over(by))
        .withColumn("band", F.sum("n").over(up.rangeBetween(-WORD, 0)))
        .withColumn("short", F.col("length") * F.col("band") - F.sum(F.col("n") * F.col("length")).over(up.rangeBetween(-WORD, 0)))
        .withColumn("below", F.coalesce(F.sum("n").over(up.rangeBetween(1 - 6 * size, -size)), F.lit(0)) / 5)
    )
    simplest = -F.array_position(F.array(*map(F.lit, NAMES)), F.col("measure"))
    pile = (F.col("n") >= LEAST) & (F.col("n") >= LEAST_SHARE * F.col("all")) & (F.col("past") <= BEYOND * F.col("at"))
    spread = (F.col("band") >= LEAST_BAND) & (F.col("band") >= LEAST_SHARE * F.col("all")) & (F.col("past") <= BEYOND * F.col("band")) & (F.col("band") >= DENSER * F.col("below"))
    more = F.col("band") - F.col("below")
    whole = F.col("measure").isin(*MEASURES)
    order = F.struct(F.col("at"), F.col("n"), -F.col("past"), simplest)
    # One length is the whole limit unless the lengths just below it are too dense for texts that merely end there.
    rest = F.col("band") - F.col("at")
    loose = (rest >= LEAST_BAND) & (rest >= DENSER * F.col("below") * (WORD - SLACK) / size)
    exact = F.struct("measure", "length", "at", F.lit(SLACK).alias("width"), loose.alias("loose"))
    best = seen.groupBy("source").agg(
        F.max_by(F.when(pile & whole, exact), F.when(pile & whole, order)).alias("whole"),
        F.max_by(F.when(pile & ~whole, exact), F.when(pile & ~whole, order)).alias("bare"),
        F.max_by(F.when(spread, F.struct("measure", "length", F.col("band").alias("at"), F.lit(WORD).alias("width"), F.lit(True).alias("loose"))), F.when(spread, F.struct(more - F.col("past"), -F.col("short"), simplest))).alias("w"),
    )
    as_is = F.col("whole").isNotNull() & (F.col("bare").isNull() | (F.col("whole.at") >= MOST * F.col("bare.at")))
    best = best.withColumn("p", F.when(as_is, F.col("whole")).otherwise(F.col("bare")))
    held = F.col("p").isNotNull() & (F.col("w").isNull() | ~F.col("p.loose"))
    best = best.withColumn("b", F.when(held, F.col("p")).otherwise(F.col("w"))).filter("b is not null")
    return best.select("source", F.col("b.measure").alias("measure"), F.col("b.length").alias("field_limit"), F.col("b.at").alias("at"), F.col("b.width").alias("width"))


def truncated(docs: DataFrame, doc_id: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, truncated, at_limit), limits) for every document with an id and a text.

    A NULL or empty text is complete; a NULL source is a source of its own;
    repeated rows of one document count once (truncated if one of them is).
    Whole texts are read; limits and ending statistics cover all documents.
    """
    base = docs.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))
    kinds = T.StructType([f for f in base.schema.fields if f.name != "text"] + T.StructType.fromDDL("lengths array<long>, ending string, tail string, shape string").fields)
    feats = materialise(base.mapInPandas(_features, kinds), "endings")
    limits = hidden_limits(feats)
    total = feats.count()
    formulas = feats.filter("shape is not null").groupBy("shape").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(LEAST, FORMULA_SHARE * total)).select("shape", F.lit(True).alias("formula"))
    # Only endings that have to be decided are counted on; the others go before the shuffle where the asked ones are few.
    asked = materialise(feats.filter("ending = 'open' AND tail IS NOT NULL").select("tail").distinct(), "tails")
    tails = base.select("text").mapInPandas(_tails, "tail string, n long, n_end long").join(asked, "tail", "left_semi").groupBy("tail").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"))
    place = F.array_position(F.array(*map(F.lit, NAMES)), F.col("measure"))
    length = F.try_element_at("lengths", place.cast("int"))
    open_ = feats.filter("ending = 'open'").join(formulas, "shape", "left").join(tails, "tail", "left").join(limits, "source", "left")
    at_limit = F.coalesce(F.col("field_limit").isNotNull() & length.between(F.col("field_limit") - F.col("width"), F.col("field_limit")), F.lit(False))
    likely = F.coalesce((F.col("n_end") >= LEAST) & (F.col("n_end") >= ENDS * F.col("n")), F.lit(False))
    possible = F.coalesce(F.col("n_end") > 0, F.lit(False))
    # In a source that leaves the last mark out by habit any known ending will do.
    judged = open_.select("doc_id", "source", at_limit.alias("at_limit"), F.coalesce("formula", F.lit(False)).alias("formula"), likely.alias("likely"), possible.alias("possible"))
    plain = judged.filter(~F.col("formula") & ~F.col("at_limit")).groupBy("source").agg((F.count_if("likely") >= HABIT * F.count(F.lit(1))).alias("habit"))
    judged = judged.join(plain, "source", "left")
    ends = F.col("likely") | (F.coalesce("habit", F.lit(False)) & F.col("possible"))
    # A closing formula is complete, at a limit or not; else a text at its limit is cut; else the corpus tells whether sentences end like this.
    decided = judged.select("doc_id", "source", F.when(F.col("formula"), F.lit(False)).when(F.col("at_limit"), F.lit(True)).otherwise(~ends).alias("cut"), "at_limit")
    rest = feats.filter("ending <> 'open'").join(limits, "source", "left").select("doc_id", "source", F.col("ending").isin("marked", "broken").alias("cut"), at_limit.alias("at_limit"))
    every = decided.unionByName(rest).groupBy("doc_id", "source").agg(F.bool_or("cut").alias("truncated"), F.bool_or("at_limit").alias("at_limit"))
    return every.withColumn("source", F.nullif("source", F.lit(""))), limits


def truncation_report(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(source, documents, truncated, share, measure, field_limit) per source; the last two NULL where no limit shows."""
    rows, limits = truncated(docs, doc_id, text, source)
    per = rows.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.count_if("truncated").alias("truncated"))
    return per.join(limits, "source", "left").select(F.nullif("source", F.lit("")).alias("source"), "documents", "truncated", (F.col("truncated") / F.col("documents")).alias("share"), "measure", "field_limit")
