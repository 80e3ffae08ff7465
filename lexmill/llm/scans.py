"""Noise in text from scanned pages: misread words, page matter, words carried over line ends.

Words are grouped by their confusable-glyph skeleton: glyphs that are mistaken
for each other fall together, so a word and its misreadings share a group.  In
a group the frequent form is right; a rare form is a misreading of it, unless
its context speaks for it.  Running heads and page numbers are lines whose
digit-masked form recurs or that repeat the document's own title.  SQL windows
over the lines number the paragraphs and carry broken words over, and the lines
are reflowed into paragraphs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexmill.session import materialise

#: Bits of a filter that spares workers most lookups: its size is fixed, a set bit is always confirmed by a join.
FILTER_BITS = 1 << 23
#: A form is a misreading if the group's leading form is this many times as frequent, and this often seen.
RATIO, SUPPORT = 5, 4
#: A pair of words is one split word if the whole is this many times as frequent as the pair.
SPLIT_RATIO = 10
#: A masked line is a running head if so many documents have it.
HEAD_DOCS = 3
#: A line in capitals is one too if it is so many misread characters from one; shorter lines than this are headings.
HEAD_EDITS, HEAD_LEAST = 3, 13

# Glyphs mistaken for each other, by class, then pairs mistaken for one glyph.
_CLASSES = str.maketrans({**dict.fromkeys("i1|!líì", "l"), **dict.fromkeys("o0", "o"), **dict.fromkeys("ec£€", "c"), **dict.fromkeys("tf", "t"), **dict.fromkeys("hb8", "b"), **dict.fromkeys("gq9", "g"), **dict.fromkeys("s§5$", "s")})
_PAIRS = {"rn": "m", "rl": "n", "ll": "u", "vv": "w", "cl": "d"}
_PAIR = re.compile("|".join(_PAIRS))
#: Specks that a scanner sets into words.
_SPECKS = "•*^~°¤¨`´"
_SPECK = re.compile(f"[{re.escape(_SPECKS)}]")
_LIGATURES = str.maketrans({"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"})
_WORD = re.compile(rf"[^\W_]+(?:[{re.escape(_SPECKS)}§£€|¦'’][^\W_]+|[{re.escape(_SPECKS)}§£€|¦])*|[§£€|][^\W_]+(?:[§£€|{re.escape(_SPECKS)}'’]*[^\W_]+)*")
_HYPHENS = "-‐¬­"
_NUMBERISH = re.compile(r"\d+[A-Z]?|[A-Z]{1,2}\d+|\d+(?:st|nd|rd|th)")
_MARGIN = re.compile(r"^\s*[A-H]\s*$")
_MARGIN_SIDE = re.compile(r"(\S)(?:\s{2,}|\t)[A-H]\s*$|^[A-H](?:\s{2,}|\t)(?=\S)")
_MARGINS = frozenset("ABCDEFGH")
_HEAD_END = re.compile(r"\(\d{4}\)\s*$|\.{2,}\s*\d*$|\[|\d\s*$")
_PAGE_NO = re.compile(r"^\W*(?:page\s+)?\[?\s*[-–—]?\s*\d{1,4}\s*[-–—]?\s*\]?(?:\s+of\s+\d+)?\W*$", re.I)


@lru_cache(maxsize=500_000)
def folded(word: str) -> str:
    return word.translate(_LIGATURES).lower().replace("’", "'")


def skeleton(word: str) -> str:
    """The word with confusable glyphs made one and specks taken out."""
    return skeletons(word)[0]


def skeletons(word: str) -> tuple[str, str, str]:
    """The skeleton with pairs read from the left, and those with u (misread ii) read before all others from either side."""
    base = _SPECK.sub("", folded(word)).replace("'", "").translate(_CLASSES)
    return _paired(base), _paired(base.replace("ll", "u")), _paired(base[::-1].replace("ll", "u")[::-1])


def _paired(now: str) -> str:
    while (then := _PAIR.sub(lambda m: _PAIRS[m[0]], now)) != now:
        now = then
    return now


def page_range(key: str | None) -> tuple[int, int] | None:
    """First and last page in a path such as 1959_11_301_309."""
    m = re.search(r"\d{4}_\d+_(\d+)_(\d+)", key or "")
    return (int(m[1]), int(m[2])) if m else None


def masked(line: str) -> str:
    """A line's form without digits, specks and misreadings."""
    return re.sub(r"\s+", " ", re.sub(r"[0-9]+", "9", skeleton(re.sub(r"[0-9]+", "0", line.strip()))))


def _near(a: str, b: str, most: int) -> bool:
    """Whether two strings are alike but for ``most`` misread characters, counted from both ends."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return False
        row = new
    return row[-1] <= most


def _title_lines(lines: list[str]) -> int:
    """Number of lines of the title block: those before the first empty one."""
    n = 0
    while n < len(lines) and lines[n].strip():
        n += 1
    return n if n < len(lines) and n <= 12 else 0


def _capitals(bare: str) -> bool:
    return sum(map(str.isupper, bare)) > 0.5 * sum(map(str.isalpha, bare))


def page_matter(line: str, pages: tuple[int, int] | None, title: str, heads: frozenset[str]) -> bool:
    """Whether a whole line belongs to the page and not to the text; ``heads``: masked forms of running heads."""
    bare = line.replace("\f", "").strip()
    if not bare:
        return False
    if "\f" in line and len(bare) < 90 or _MARGIN.match(bare):
        return True
    if _PAGE_NO.match(bare):
        n = int(re.search(r"\d+", bare)[0])
        return not bare[-1] == "." and (not bare.isdigit() or pages is None or pages[0] - 1 <= n <= pages[1] + 1)
    capitals = _capitals(bare)
    marked = bare.upper() == bare or _HEAD_END.search(bare)
    if not capitals and not marked:
        return False
    if heads and masked(bare) in heads:
        return True
    # The document's own title, perhaps cut, with a page number, a year or judges beside it.
    if not marked:
        return False
    own, this = _title_form(title), re.sub(r"[^a-z0-9]", "", skeleton(re.sub(r"^\W*\d*\W*", "", bare)))
    return len(own) >= 8 and _near(this[:12], own[:12], 2 if capitals else 1)


@lru_cache(maxsize=10_000)
def _title_form(title: str) -> str:
    return re.sub(r"[^a-z0-9]", "", skeleton(title))


def _carried(line: str) -> bool:
    """Whether the last word goes on in the next line: a letter and a hyphen at the end."""
    t = line.rstrip()
    return len(t) > 1 and t[-1] in _HYPHENS and t[-2].isalnum() and not t[-2].isdigit()


def _without_margin(line: str) -> str:
    """The line without a margin letter beside its words."""
    t = line.rstrip()
    return _MARGIN_SIDE.sub(r"\1", line) if t[-1:] in _MARGINS or t[:1] in _MARGINS else line


def _lines(text: str) -> tuple[list[str], int, str]:
    lines = text.split("\n")
    n = _title_lines(lines)
    return lines, n, " ".join(lines[: max(0, n - 2)]) if n else ""


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Word forms of whole documents, added up per worker, and the masked lines of each scan that may be running heads."""
    forms: Counter[tuple[str, bool]] = Counter()
    heads: list[tuple[str, str, bool]] = []

    def out() -> pd.DataFrame:
        rows = [("w", f, n, n if d else 0, None) for (f, d), n in forms.items()] + [("h", h, 1, int(c), doc) for doc, h, c in heads]
        return pd.DataFrame(rows, columns=["what", "form", "n", "clean", "doc_id"])

    for b in batches:
        for doc, text, layer in zip(b["doc_id"], b["text"], b["layer"]):
            lines, top, _ = _lines(text)
            digital = layer != "scan"
            carry = ""
            seen: dict[str, bool] = {}
            for whole in lines[top:]:
                line = _without_margin(whole)
                words = [folded(w) for w in _WORD.findall(line)]
                if carry and words:
                    words[0] = carry + words[0]
                carry = ""
                if words and _carried(line):
                    carry = words.pop()
                forms.update((w, digital) for w in words)
                bare = whole.replace("\f", "").strip()
                if not digital and len(bare) >= HEAD_LEAST and sum(map(str.isupper, bare)) > len(bare) / 3:
                    form = masked(bare)
                    seen[form] = seen.get(form, False) or _capitals(bare)
            heads += [(doc, h, c) for h, c in seen.items()]
        if len(forms) + len(heads) > 200_000:
            yield out()
            forms, heads = Counter(), []
    yield out()


def word_forms(counts: DataFrame) -> DataFrame:
    """(form, n, clean): word forms with their counts over all documents, and over those that were not scanned."""
    return counts.filter("what = 'w'").groupBy("form").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean"))


def running_heads(counts: DataFrame) -> DataFrame:
    """(doc_id, heads): the masked forms of each document's lines that recur as heads or are a misread head.

    A misread head lies within HEAD_EDITS of one.  Cut into one part more than
    edits, a head shares a part with it, at most so many places off, so the
    two meet on (part, text of the part) and are then compared.
    """
    lines = counts.filter("what = 'h'").select("doc_id", "form", (F.col("clean") > 0).alias("capitals"))
    forms = materialise(lines.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.bool_or("capitals").alias("capitals")), "heads")
    parts = HEAD_EDITS + 1

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for form, head in zip(b["form"], b["head"]):
                # A line's parts are those of every head it may be a misreading of: as long, or a few characters longer or shorter.
                for n in [len(form)] if head else range(max(parts, len(form) - HEAD_EDITS), len(form) + HEAD_EDITS + 1):
                    for k in range(parts):
                        lo, hi = n * k // parts, n * (k + 1) // parts
                        for off in [0] if head else range(-HEAD_EDITS, HEAD_EDITS + 1):
                            if 0 <= lo + off and hi + off <= len(form):
                                rows.append((form, head, n, k, form[lo + off : hi + off]))
            yield pd.DataFrame(rows, columns=["form", "head", "n", "part", "piece"]).drop_duplicates()

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[_near(x, y, HEAD_EDITS) for x, y in zip(b["form"], b["of"])], ["form"]]

    cut = forms.filter((F.col("n") >= HEAD_DOCS) | F.col("capitals")).select("form", (F.col("n") >= HEAD_DOCS).alias("head")).mapInPandas(pieces, "form string, head boolean, n int, part int, piece string")
    mine = cut.filter("head").select("n", "part", "piece", F.col("form").alias("of"))
    met = cut.filter("not head").join(mine, ["n", "part", "piece"]).select("form", "of").distinct().mapInPandas(near, "form string")
    every = forms.filter(F.col("n") >= HEAD_DOCS).select("form").union(met).distinct()
    return lines.join(every, "form").groupBy("doc_id").agg(F.collect_set("form").alias("heads"))


class _Filter:
    """Forms that may be in a table: no for most others, never no for one that is in it."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.mask = 64 * len(words) - 1
        self.known: dict[str, bool] = {}

    def __contains__(self, form: str) -> bool:
        got = self.known.get(form)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            at = xxhash.xxh64_intdigest(form.encode("utf-8", "surrogatepass"), seed=42) & self.mask
            got = self.known[form] = bool(int(self.words[at >> 6]) >> (at & 63) & 1)
        return got


def _filters(*tables: DataFrame) -> list:
    """A broadcast filter of each table's ``form``, from one job."""
    spark = tables[0].sparkSession
    rows = tables[0].select(F.lit(0).alias("t"), "form")
    for i, t in enumerate(tables[1:], 1):
        rows = rows.union(t.select(F.lit(i), "form"))
    at = F.pmod(F.xxhash64("form"), F.lit(FILTER_BITS))
    bits = rows.filter("form is not null").groupBy("t", F.floor(at / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("bits"))
    filters = np.zeros((len(tables), FILTER_BITS // 64), dtype=np.uint64)
    got = bits.toPandas()
    filters[got["t"].to_numpy(np.int64), got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return [spark.sparkContext.broadcast(f) for f in filters]


def corrections(forms: DataFrame) -> DataFrame:
    """(form, fixed, n, m, known): rare forms of a skeleton group with the group's leading form.

    A group holds the spellings of one skeleton, a handful; the leading form is
    kept whole letters only.  ``known``: the form also occurs in texts that were
    not scanned, so only its context can tell.
    """

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = b["form"].map(skeletons)
            for way in range(3):
                yield b.assign(skeleton=[f"{way}{s[way]}" for s in both])

    words = forms.select("form", "n", "clean").mapInPandas(grouped, "form string, n long, clean long, skeleton string")
    plain = F.col("form").rlike(r"^[\p{L}]+('[\p{L}]+)?$")
    lead = words.filter(plain).groupBy("skeleton").agg(F.max_by(F.struct("form", "n"), F.struct("clean", "n", "form")).alias("lead"))
    pair = words.filter(F.col("form").rlike(r"\p{L}")).join(lead, "skeleton").filter((F.col("form") != F.col("lead.form")) & (F.col("lead.n") >= SUPPORT) & (F.col("lead.n") >= RATIO * F.col("n")) & (F.length("form") > 1))
    one = pair.groupBy("form").agg(F.max_by(F.struct("lead", "n", "clean"), F.struct("lead.n", "lead.form")).alias("p"))
    return one.select("form", F.col("p.lead.form").alias("fixed"), F.col("p.n").alias("n"), F.col("p.lead.n").alias("m"), (F.col("p.clean") > 0).alias("known"))


def _pairs(known, wanted):
    """Counter of word pairs that may be one split word, and of the contexts of forms that may be misreadings or misread."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wholes, asked = _Filter(known.value), _Filter(wanted.value)
        pairs: Counter[tuple[str, str, str]] = Counter()
        for b in batches:
            for text in b["text"]:
                last = ""
                for raw in _WORD.findall(text):
                    w = folded(raw)
                    if last and last + w in wholes:
                        pairs[("s", last, w)] += 1
                    if w in asked:
                        pairs[("c", last, w)] += 1
                    last = w
            if len(pairs) > 200_000:
                yield pd.DataFrame([(*k, n) for k, n in pairs.items()], columns=["what", "a", "b", "n"])
                pairs.clear()
        yield pd.DataFrame([(*k, n) for k, n in pairs.items()], columns=["what", "a", "b", "n"])

    return count


_SIGNS = re.compile(rf"[{re.escape(_SPECKS)}§£€|¦ﬀ-ﬄ]")
_NOISY_LINE = re.compile(rf"\w[{re.escape(_SPECKS)}]|[{re.escape(_SPECKS)}]\w|[§£€]|\d['’]\d")


@lru_cache(maxsize=500_000)
def _noisy(raw: str) -> bool:
    """A form no clean word has: specks, signs or ligatures in it, or digits among its letters."""
    if _SIGNS.search(raw):
        return True
    return bool(re.search(r"[a-z]", raw.lower()) and re.search(r"\d", raw)) and not _NUMBERISH.fullmatch(raw)


def flagged_lines(docs: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(doc_id, line_no, page, carried, word, fixed) for every line of the scanned documents.

    ``docs``: (doc_id, text, layer), one row per document.  ``page``: the whole
    line is page matter; ``carried``: its last word goes on in the next line;
    ``word``: it holds a misread word, or a margin letter or form feed beside
    its words; ``fixed``: the line without them, NULL for page matter.  Lines
    of the title block are kept as they are.  NULL and empty texts have no
    lines; documents that are not scans serve the counts only.
    """
    docs = materialise(docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()), "scan-docs")
    counts = materialise(docs.mapInPandas(_count, T.StructType([*T.StructType.fromDDL("what string, form string, n long, clean long").fields, T.StructField("doc_id", docs.schema["doc_id"].dataType)])), "counts")
    forms = materialise(word_forms(counts), "forms")
    fixes = materialise(corrections(forms), "fixes")
    sure, ambiguous = fixes.filter("not known").select("form", "fixed"), fixes.filter("known").select("form", "fixed")
    wholes = forms.filter(F.col("n") >= SUPPORT).join(sure, "form", "left_anti").select("form", "n")
    pairs = materialise(docs.select("text").mapInPandas(_pairs(*_filters(wholes, ambiguous.select("form").union(ambiguous.select("fixed")))), "what string, a string, b string, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n")), "pairs")
    whole = wholes.select(F.col("form").alias("whole"), F.col("n").alias("m"))
    split = pairs.filter("what = 's'").withColumn("whole", F.concat("a", "b")).join(whole, "whole").filter((F.length("whole") > 4) & (F.col("m") >= SPLIT_RATIO * F.col("n"))).select(F.concat_ws(" ", "a", "b").alias("form"), F.col("whole").alias("fixed"))
    # An ambiguous form is a misreading where its leading form is far more frequent after the same word.
    ctx = pairs.filter("what = 'c'").select("a", "b", "n")
    other = ctx.select("a", F.col("b").alias("fixed"), F.col("n").alias("m"))
    context = ctx.join(ambiguous.withColumnRenamed("form", "b"), "b").join(other, ["a", "fixed"]).filter((F.col("m") >= SUPPORT) & (F.col("m") >= RATIO * F.col("n"))).select(F.concat_ws(" ", F.lit("@"), "a", "b").alias("form"), "fixed")
    # Single letters are initials or margins; they are never looked up.
    rules = materialise(sure.unionByName(split).unionByName(context), "rules")
    ruled, unclear = _filters(rules, ambiguous)

    beside = running_heads(counts)
    if entries is not None:
        keys = entries.filter(F.col("path").isNotNull()).groupBy(F.concat("path", F.lit("_EN")).alias("doc_id")).agg(F.min("pdf_key").alias("pdf_key"))
        beside = beside.join(keys, "doc_id", "full_outer")
    else:
        beside = beside.withColumn("pdf_key", F.lit(None).cast("string"))
    pages = docs.filter("layer = 'scan'").select("doc_id", "text").join(beside, "doc_id", "left")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row per line, with the forms in it that might be misread."""
        rule, doubt = _Filter(ruled.value), _Filter(unclear.value)
        for b in batches:
            rows = []
            for doc, text, key, known_heads in zip(b["doc_id"], b["text"], b["pdf_key"], b["heads"]):
                lines, n_top, title = _lines(text)
                heads = frozenset(known_heads) if known_heads is not None else frozenset()
                span = page_range(key) or page_range(doc)
                carry, last = "", ""
                for no, line in enumerate(lines, 1):
                    if no <= n_top or not line.strip():
                        rows.append((doc, no, line, no <= n_top, False, False, False, []))
                        continue
                    if page_matter(line, span, title, heads):
                        rows.append((doc, no, line, False, True, False, False, []))
                        continue
                    body = _without_margin(line)
                    margin = body != line or "\f" in line
                    carried = _carried(body)
                    found = _WORD.findall(body)
                    asked = []
                    noisy = False
                    ends = len(found) - 1 if carried else -1
                    for i, raw in enumerate(found):
                        w = folded(raw)
                        if i == 0 and carry:
                            if carry + w in rule:
                                asked.append(f"+{carry} {w}")
                        elif i != ends:
                            if f"{last} {w}" in rule:
                                asked.append(f"{last} {w}")
                            if w in doubt and f"@ {last} {w}" in rule:
                                asked.append(f"@ {last} {w}")
                            if len(w) > 1 and w in rule:
                                asked.append(w)
                        if _noisy(raw):
                            noisy = True
                        last = w
                    noisy = noisy or _NOISY_LINE.search(body) is not None
                    rows.append((doc, no, line, False, False, carried, margin or noisy, asked))
                    carry = folded(found[-1]) if carried and found else ""
            yield pd.DataFrame(rows, columns=["doc_id", "line_no", "line", "title", "page", "carried", "word", "asked"])

    lines = materialise(pages.mapInPandas(read, "doc_id string, line_no int, line string, title boolean, page boolean, carried boolean, word boolean, asked array<string>"), "lines")
    asked = lines.select("doc_id", "line_no", F.explode("asked").alias("form"))
    # A carried word is looked up whole, and counts for the second line where its end is misread.
    joint = asked.filter(F.col("form").startswith("+")).select("doc_id", "line_no", F.split(F.substring("form", 2, 10_000), " ").alias("p")).select("doc_id", "line_no", F.col("p")[1].alias("part"), F.concat(F.col("p")[0], F.col("p")[1]).alias("form"))
    plain = asked.filter(~F.col("form").startswith("+")).select("doc_id", "line_no", F.lit(None).cast("string").alias("part"), "form")
    hits = plain.unionByName(joint.select("doc_id", "line_no", "part", "form")).join(rules, "form").filter(F.col("part").isNull() | ~F.endswith(F.col("fixed"), F.col("part")))
    per_line = hits.groupBy("doc_id", "line_no").agg(F.map_from_entries(F.array_distinct(F.collect_set(F.struct("form", "fixed")))).alias("swaps"))
    return lines.join(per_line, ["doc_id", "line_no"], "left").select("doc_id", "line_no", "line", "title", "page", "carried", (F.col("word") | F.col("swaps").isNotNull()).alias("word"), "swaps")


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each line with its misread words put right and margins, specks and ligatures taken out."""
    for b in batches:
        out = []
        for line, swaps, title in zip(b["line"], b["swaps"], b["title"]):
            if title:
                out.append(line)
                continue
            t = _SPECK.sub("", _without_margin(line).replace("\f", "").translate(_LIGATURES))
            for form, fixed in sorted((swaps or {}).items() if isinstance(swaps, dict) else (swaps or []), key=lambda x: -len(x[0])):
                old = _SPECK.sub("", form.split(" ", 2)[2] if form.startswith("@ ") else form)
                t = re.sub(rf"(?<!\w){re.escape(old)}(?!\w)", lambda m, f=fixed: f.upper() if len(m[0]) > 1 and m[0].isupper() else f.capitalize() if m[0][:1].isupper() else f, t, flags=re.I)
            out.append(t)
        b["line"] = out
        yield b[["doc_id", "line_no", "line", "title", "page", "carried"]]


def paragraphs(flagged: DataFrame) -> DataFrame:
    """(doc_id, par_no, text): the scanned documents reflowed.

    Windows over a document's lines number the paragraphs: an empty line ends
    one unless it stands beside page matter and the text before it has no end
    mark.  A word carried over loses its hyphen.
    """
    fixed = flagged.mapInPandas(_repaired, "doc_id string, line_no int, line string, title boolean, page boolean, carried boolean").filter(~F.col("page"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    empty = F.trim("line") == ""
    body = fixed.withColumn("before", F.lag(F.when(~empty, F.col("line")), 1).over(order)).withColumn("gap", F.lag(empty, 1, False).over(order))
    last = F.last(F.when(~empty, F.col("line")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    was_title = F.last(F.when(~empty, F.col("title")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    closed = last.rlike(r"[.?!:;][\"'”’)\]]*\s*$") | was_title
    starts = F.coalesce(F.col("gap") & closed, F.lit(True)) & ~empty
    numbered = body.withColumn("starts", starts).filter(~empty).withColumn("par_no", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.rtrim(x["line"])), "\n")
    joined = numbered.groupBy("doc_id", "par_no").agg(text.alias("t"))
    return joined.select("doc_id", F.col("par_no").cast("int").alias("par_no"), F.trim(F.regexp_replace(F.regexp_replace("t", r"(?<=\p{L})[-‐¬­]\n\s*(?=\p{Ll})", ""), r"\s*\n\s*", " ")).alias("text"))
