"""Sentence boundaries across languages and scripts: cascading segmentation rules.

Each position after an end mark, and each line end, is a possible boundary.
The rule tables of the language at that position, then the common table, are
read in order; a rule is a pair of regular expressions for the text before and
after the position, and the first pair that matches decides: break or no break.
Positions inside a quotation or bracket that closes again are no boundaries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``before`` must match up to the position, read backwards from it, ``after`` from it on; both see the whole text."""

    breaks: bool
    before: regex.Pattern
    after: regex.Pattern


def _rule(breaks: bool, before: str, after: str = "") -> Rule:
    return Rule(breaks, regex.compile(f"(?r)(?:{before})"), regex.compile(after))


_CLOSE = r"[\"'”’»)\]」』）]*"
# English and Indian legal abbreviations.  The first never end a sentence; the second may.
_NEVER = (
    r"Mr|Mrs|Ms|Messrs|M/s|Smt|Kum|Dr|mr|messrs|m/s|smt|dr|Shri|Sri|Sr|Jr|Prof|Hon|Hon'ble|Gen|Col|Capt|St|Ex|Exs|Exh|Annex|No|Nos|no|nos|Rs|Re|Art|Arts|Sec|Secs|Cl|cl|cls|para|paras|Para|Paras|"
    r"sub-s|sub-cl|ss|pp|Crl|Civ|Cri|Supp|Suppl|Vol|vol|Ch|Sch|Reg|viz|cf|Cf|vs|Vs|Dist|Distt|Tq|Govt|Dept|Corpn|Pvt|approx|C|CF|SM|TE|JW"
)
_MAYBE = r"Ltd|Ors|Anr|Bros|Co|Inc|etc|Adv|JJ|a\.m|p\.m|Cr\.P\.C|C\.P\.C|I\.P\.C|km|kms|cm|kg|Rly"
#: Where an abbreviation may begin: also right after an end mark whose space is missing.
_WORD_START = r"(?:^|[\s(\[\"“'‘/,;]|(?<=[a-z]{2}[.?!])|(?<=[0-9)][.?!])|(?<=[ap]\.m\.))"

#: Stands in a rule for the ends of a run of single letters with full stops (found once for a text, see ``_initials``).
INITIALS = regex.compile(r"(?:[A-Za-z]\.)+")
_AT_WORD_START = regex.compile(f"(?r){_WORD_START}")
#: Language -> rules, read before the common ones.
TABLES: dict[str, list[Rule]] = {
    "en": [
        _rule(False, rf"{_WORD_START}(?:{_NEVER})\."),
        # Two capitals shorten a firm's name where the form of company follows.
        _rule(False, r"\s[A-Z]{1,3}\.", r"\s+(?:Ltd|Pvt|Co)\b"),
        # Initials, reporter and witness abbreviations: single letters with full stops.
        Rule(False, INITIALS, regex.compile("")),
        _rule(False, rf"{_WORD_START}(?:{_MAYBE})\.", r"\s+(?:[a-z0-9(\[&]|V/s\b|Vs\b|versus\b|A\.I\.R)"),
        _rule(True, rf"{_WORD_START}(?:{_MAYBE})\.", r"\s+\S"),
        # The space after an end mark may be missing before a capitalised word.
        _rule(True, r"(?:[a-z]{2}|\d|\w\)|/-|[ap]\.m)[.?!]", r"[\"“]?[A-Z][A-Za-z/'-]*[\s,.]|[ऀ-ॿ]"),
        _rule(True, r"[.?!][\"”’]", r"[A-Z][a-z]"),
    ],
    "hi": [
        _rule(False, r"(?:^|[\s(\"“।॥|!?])(?:रु|नं|डॉ|श्री|प्रो|क्र|पृ|सं|ई|मो|बी|एम|एस)\."),
        # A quotation that its sentence goes on after.
        _rule(False, r"[।॥|?!.][\"'”’]", r"\s*(?:और|तथा|एवं|व|लेकिन|किन्तु|परन्तु|ऐसा|कहकर|यह कहा)\s"),
        _rule(True, rf"[।॥|]{_CLOSE}", r"\s|$|[ऀ-ॿA-Z]"),
    ],
    "ur": [
        _rule(False, r"(?:^|\s)(?:ڈاکٹر|نمبر)\."),
        _rule(False, r"[۔؟!.][\"'”’]", r"\s*(?:اور|لیکن|مگر|کہہ کر)\s"),
        _rule(True, rf"[۔؟]{_CLOSE}", r""),
    ],
    "ta": [_rule(False, r"[.!?][\"'”’]", r"\s*(?:என்று|எனவும்|என|ஆனால்)\s"), _rule(False, r"(?:^|[\s(\"“.!?])(?:திரு|திருமதி|ரூ|எண்|டாக்டர்|செல்வி|பக்)\.")],
    "zh": [_rule(True, rf"[。！？]{_CLOSE}", r"")],
}
#: Rules of every language, read last.
COMMON: list[Rule] = [
    # The number that opens a paragraph, and a fragment's leading dots, belong to what follows.
    _rule(False, r"(?:^|\n)[ \t]*\(?(?:[0-9०-९۰-۹௦-௯]{1,3}|[IVXivx]{1,5}|[A-Za-z])[.)]", r"[ \t]+\S"),
    _rule(False, r"(?:^|\n)[ \t]*(?:\.{2,}|…)", r""),
    # Decimals, dates, sections: a digit follows directly.
    _rule(False, r"\d\.", r"\d"),
    _rule(False, r"[.?!…]", r"[^\s\"'”’)\]ऀ-ॿ஀-௿؀-ۿ一-鿿]"),
    # A sentence does not go on in lower case or with a comma.
    _rule(False, rf"[.?!…]{_CLOSE}", r"\s*[,;:]|\s+[a-z&–—-]"),
    _rule(True, rf"[.?!…।॥۔؟。！？]{_CLOSE}", r"\s|$|[ऀ-ॿ஀-௿؀-ۿ一-鿿]"),
]
_CASCADE = {lang: [*rules, *COMMON] for lang, rules in TABLES.items()}
_CANDIDATE = re.compile(rf"[.?!।॥۔؟。！？…|]+{_CLOSE}(?<!\|\|)")
_LINE = re.compile(r"[ \t\r]*\n\s*")
_PAIRS = {"“": "”", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "‘": "’"}
_BRACKET = re.compile(r'["“”「」『』()\[\]（）‘’]')
#: A letter tells the language by its script.
_LETTER = {
    "en": re.compile(r"[A-Za-z]"), "hi": re.compile(r"[\u0900-\u0963\u0966-\u097f]"), "ur": re.compile(r"[\u0600-\u060b\u060d-\u061e\u0620-\u06d3\u06d5-\u06ff]"),
    "ta": re.compile(r"[\u0b80-\u0bff]"), "zh": re.compile(r"[\u3400-\u9fff]"),
}
_ANY_LETTER = regex.compile("(?r)" + "|".join(f"(?P<{lang}>{p.pattern})" for lang, p in _LETTER.items()))


def language(text: str, at: int, since: int = 0, before: str = "en") -> str:
    """The language of the last letter between ``since`` and ``at``, by its script; ``before`` if there is none."""
    m = _ANY_LETTER.search(text, since, at)
    return m.lastgroup if m else before


def _enclosed(text: str) -> list[tuple[int, int]]:
    """Outermost quotations and brackets as (first, last) character positions.

    An opening mark is closed by its partner, marks of its own kind between
    them paired among themselves, on the same line however far; one left open
    encloses nothing.  One pass finds the partners, so a line costs its length.
    """
    spans: list[tuple[int, int]] = []
    begun = 0
    for line in text.split("\n"):
        marks = [(m.start(), m[0]) for m in _BRACKET.finditer(line)]
        if len(marks) > 1:
            partner: dict[int, int] = {}
            waiting: dict[str, list[int]] = {close: [] for close in _PAIRS.values()}
            quotes = []
            for at, c in marks:
                if c == '"':
                    quotes.append(at)
                elif c in waiting:
                    if waiting[c]:
                        partner[waiting[c].pop()] = at
                elif not (c == "‘" and at and line[at - 1].isalnum()):
                    waiting[_PAIRS[c]].append(at)
            after = dict(zip(quotes, quotes[1:]))
            done = -1
            for at, c in marks:
                end = after.get(at) if c == '"' else partner.get(at)
                if at > done and end is not None:
                    spans.append((begun + at, begun + end))
                    done = end
        begun += len(line) + 1
    return spans


def _initials(text: str) -> set[int]:
    """Ends of single letters with full stops in a run that begins where a word does; a time of day is none."""
    ends = set()
    for m in INITIALS.finditer(text):
        first = next((p for p in range(m.start(), m.end(), 2) if _AT_WORD_START.match(text, 0, p)), m.end())
        ends.update(e for e in range(first + 2, m.end() + 1, 2) if text[e - 4 : e] not in ("a.m.", "p.m."))
    return ends


def _decide(text: str, at: int, lang: str, initials: set[int]) -> bool:
    if text[at - 1] == "|" and lang != "hi":
        return False
    for rule in _CASCADE[lang]:
        if (at in initials if rule.before is INITIALS else rule.before.match(text, 0, at)) and rule.after.match(text, at):
            return rule.breaks
    return False


def _line_breaks(text: str, start: int, end: int) -> bool:
    """Whether a line end is a boundary: after an end mark, a heading's line, a blank line, before a numbered paragraph or a capital."""
    if text.count("\n", start, end) > 1 or end >= len(text):
        return True
    line = text[text.rfind("\n", 0, start) + 1 : start].rstrip()
    if not line or re.search(rf"[.?!।॥۔؟。！？|:…]{_CLOSE}$", line):
        return not re.search(rf"{_WORD_START}(?:{_NEVER})\.$", line)
    return not (text[end].islower() or line[-1] in ",;-–—(")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence; every character that is not blank lies in exactly one."""
    inside = _enclosed(text)
    ascii_only = text.isascii()
    initials = _initials(text)
    cuts = []
    k = read = 0
    lang = "en"
    opens = {s for s, _ in inside}
    # A closing mark that opens the next quotation is none.
    marks = [(next((i for i in range(m.start() + 1, m.end()) if i in opens), m.end()), False, m) for m in _CANDIDATE.finditer(text)] + [(m.start(), True, m) for m in _LINE.finditer(text)]
    for at, line, m in sorted(marks, key=lambda x: (x[0], x[1])):
        while k < len(inside) and inside[k][1] < at:
            k += 1
        if k < len(inside) and inside[k][0] < at <= inside[k][1]:
            continue
        if line:
            found = _line_breaks(text, m.start(), m.end())
        else:
            if not ascii_only:
                lang, read = language(text, at, read, lang), at
            found = _decide(text, at, lang, initials)
        if found:
            cuts.append(at)
    spans = []
    start = 0
    for end in [*cuts, len(text)]:
        part = text[start:end]
        if part.strip():
            lead = len(part) - len(part.lstrip())
            spans.append((start + lead, start + len(part.rstrip())))
        start = max(start, end)
    return spans


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sent_no, sent_start, sent_end) of every text, offsets in characters.

    A NULL, empty or blank text has no sentences; a NULL key is kept; repeated
    rows are split again (take them out before if need be).  One narrow pass.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, s, e) for k, t in zip(b["k"], b["t"]) for i, (s, e) in enumerate(sentence_spans(t))]
            yield pd.DataFrame(rows, columns=["key", "sent_no", "sent_start", "sent_end"])

    base = df.filter(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return base.mapInPandas(split, "key string, sent_no int, sent_start int, sent_end int")
