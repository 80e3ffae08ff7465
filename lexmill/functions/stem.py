"""Porter's suffix stripping (1980), evaluated once per distinct word."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The suffix tables of the published algorithm, each longest match first.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log", "fulli": "ful"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
_IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}


def _shape(stem: str) -> str:
    """A stem as c and v; y counts as a vowel after a consonant."""
    out = ""
    for i, c in enumerate(stem):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(word: str) -> bool:
    s = _shape(word)
    return (len(s) >= 3 and s.endswith("cvc") and word[-1] not in "wxy") or (len(s) == 2 and s == "vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _swap(word: str, table: dict[str, str], least: int) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if suffix == "logi":
                return stem + "log" if _measure(stem + "l") >= least else word
            return stem + table[suffix] if _measure(stem) >= least else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of one lower-case word; words of two letters stay."""
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    if len(word) <= 2:
        return word
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("ies"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in _shape(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and len(word) > 2 and _shape(word)[-2] == "c":
        word = word[:-1] + "i"
    word = _swap(word, _STEP2, 1)
    word = _swap(word, _STEP3, 1)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest[-1:] in "st"):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short(rest)):
            word = rest
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(T.StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_tokens(tokens: pd.Series) -> pd.Series:
    """Each token's stem; abbreviations, numbers and sections stay as they are."""
    return tokens.map(lambda ts: [stem_token(t) for t in ts], na_action="ignore")


@lru_cache(maxsize=200_000)
def stem_token(token: str) -> str:
    from lexmill.functions.text import LEGAL, LEGAL_NUMBER

    return token if token in LEGAL or re.match(LEGAL_NUMBER, token) else stem(token)


def stemmed(postings: DataFrame, term: str = "term") -> DataFrame:
    """Replace the terms by their stems: only distinct words go through Python, the result joins back."""
    from lexmill.functions.text import is_legal

    words = postings.select(term).distinct()
    table = words.withColumn("_stem", F.when(is_legal(F.col(term)), F.col(term)).otherwise(stem_udf(term)))
    return postings.join(table, term).withColumn(term, F.col("_stem")).drop("_stem")
