"""SQL fragments shared by the comparison queries."""

from __future__ import annotations

from lexmill.functions import stem as stemming
from lexmill.functions.text import LEGAL, LEGAL_NUMBER, STOP, TOKEN
from lexmill.operators.index import ZONE_WEIGHT, ZONES


def words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def raw_tokens_of(text: str) -> str:
    """All tokens of a text expression, stop words included."""
    t = f"regexp_replace(coalesce({text}, ''), '\\[([0-9]{{4}})\\]', '\\1', 'g')"
    for dotted, plain in ((r"(?i)\bS\.C\.R\.", "SCR"), (r"(?i)\bS\.C\.C\.", "SCC"), (r"(?i)\bI\.N\.S\.C\.", "INSC"), (r"(?i)\bCr\.\s*P\.?\s*C\.", "CrPC")):
        t = f"regexp_replace({t}, '{dotted}', '{plain}', 'g')"
    return f"regexp_extract_all(lower({t}), '{TOKEN}')"


def tokens_of(text: str) -> str:
    """A list of tokens of a text expression."""
    return f"list_filter({raw_tokens_of(text)}, lambda x: x IN ({words(LEGAL)}) OR regexp_matches(x, '{LEGAL_NUMBER}') OR x NOT IN ({words(STOP)}))"


ZONE_CTE = f"""
zl AS (SELECT DISTINCT doc_id, unnest(map_keys(zones)) AS zone, unnest(map_values(zones)) AS text FROM judgments WHERE doc_id IS NOT NULL),
z AS (SELECT doc_id, zone, min(text) AS text FROM zl WHERE zone IN ({words(ZONES)}) GROUP BY ALL),
tk AS (SELECT doc_id, zone, {tokens_of('text')} AS t FROM z),
p AS (SELECT doc_id, zone, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM tk),
size AS (SELECT doc_id, zone, len(t) AS len FROM tk)"""

WEIGHT_CASE = "CASE zone " + " ".join(f"WHEN '{z}' THEN {w}" for z, w in ZONE_WEIGHT.items()) + " END"

JUDGMENT_CTE = """
j AS (SELECT doc_id, min(title) AS title, min(decision_date) AS decision_date, min(bench_size) AS bench_size, min(text) AS text FROM judgments WHERE doc_id IS NOT NULL GROUP BY doc_id)"""


def _porter() -> str:
    """Porter's suffix stripping as a chain of common table expressions over ``vocabulary(word)``, by regular expressions.

    It shares nothing with the stemmer it is compared with but the algorithm's suffix tables.  A y after a consonant is
    a vowel; the other ys are written Y before a measure is taken.
    """
    y = lambda s: f"regexp_replace(regexp_replace({s}, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g')"
    c, v = "[^aeiouy]", "[aeiouy]"
    least = lambda s, m: f"regexp_matches({y(s)}, '^{c}*{f'{v}+{c}+' * m}')"
    short = lambda s: f"(regexp_matches({y(s)}, '{c}{v}[^aeiouywxY]$') OR regexp_matches({y(s)}, '^{v}{c}$'))"
    drop = lambda s, n: f"left({s}, length({s}) - {n})"

    def table(source: str, name: str, suffixes: dict[str, str], m: int) -> str:
        """One step: the longest suffix of the table, replaced if the stem before it is long enough."""
        longest = f"regexp_extract(w, '({'|'.join(sorted(suffixes, key=len, reverse=True))})$', 1)"
        stem = drop("w", "length(sfx)")
        special = f" WHEN sfx = 'logi' THEN CASE WHEN {least(stem + ' || chr(108)', m)} THEN {stem} || 'log' ELSE w END" if "logi" in suffixes else ""
        special += f" WHEN sfx = 'ion' AND NOT regexp_matches({stem}, '[st]$') THEN w" if "ion" in suffixes else ""
        new = "CASE sfx " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in suffixes.items()) + " END"
        return f"{name}a AS (SELECT word, w, {longest} AS sfx FROM {source}), {name} AS (SELECT word, CASE WHEN sfx = '' THEN w{special} WHEN {least(stem, m)} THEN {stem} || {new} ELSE w END AS w FROM {name}a)"

    plural = f"CASE WHEN w LIKE '%sses' THEN {drop('w', 2)} WHEN w LIKE '%ies' THEN {drop('w', 'CASE WHEN length(w) = 4 THEN 1 ELSE 2 END')} WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN {drop('w', 1)} ELSE w END"
    past = f"""CASE WHEN w LIKE '%ied' THEN {drop('w', 'CASE WHEN length(w) = 4 THEN 1 ELSE 2 END')} WHEN w LIKE '%eed' THEN CASE WHEN {least(drop('w', 3), 1)} THEN {drop('w', 1)} ELSE w END
      WHEN cut > 0 AND regexp_matches({y(drop('w', 'cut'))}, '{v}') THEN CASE WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e'
        WHEN length(b) > 1 AND right(b, 1) = left(right(b, 2), 1) AND regexp_matches({y('b')}, '{c}$') AND NOT regexp_matches(b, '[lsz]$') THEN {drop('b', 1)} WHEN {least('b', 1)} AND NOT {least('b', 2)} AND {short('b')} THEN b || 'e' ELSE b END ELSE w END"""
    irregular = "CASE word " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in stemming._IRREGULAR.items()) + " END"
    return f"""
s0 AS (SELECT word, word AS w FROM vocabulary), s1 AS (SELECT word, {plural} AS w FROM s0),
s2a AS (SELECT word, w, CASE WHEN w LIKE '%ed' THEN 2 WHEN w LIKE '%ing' THEN 3 ELSE 0 END AS cut FROM s1), s2b AS (SELECT *, {drop('w', 'cut')} AS b FROM s2a),
s2 AS (SELECT word, {past} AS w FROM s2b),
s3 AS (SELECT word, CASE WHEN length(w) > 2 AND w LIKE '%y' AND regexp_matches({y(drop('w', 1))}, '{c}$') THEN {drop('w', 1)} || 'i' ELSE w END AS w FROM s2),
{table('s3', 's4', stemming._STEP2, 1)}, {table('s4', 's5', stemming._STEP3, 1)}, {table('s5', 's6', dict.fromkeys(stemming._STEP4, ''), 2)},
s7 AS (SELECT word, CASE WHEN w LIKE '%e' AND ({least(drop('w', 1), 2)} OR ({least(drop('w', 1), 1)} AND NOT {short(drop('w', 1))})) THEN {drop('w', 1)} ELSE w END AS w FROM s6),
s8 AS (SELECT word, CASE WHEN w LIKE '%ll' AND {least(drop('w', 1), 2)} THEN {drop('w', 1)} ELSE w END AS w FROM s7),
stems AS (SELECT word, CASE WHEN word IN ({words(LEGAL)}) OR regexp_matches(word, '{LEGAL_NUMBER}') OR length(word) <= 2 THEN word ELSE coalesce({irregular}, w) END AS stem FROM s8)"""


#: Words the comparison queries ask for besides those of the texts.
ASKED = ["confession", "confessions", "recovery", "recoveries", "murder", "murdered", "302", "dying", "declaration", "evidence", "proceedings"]
STEM_CTE = ZONE_CTE.replace("\np AS (", "\np0 AS (") + f""",
vocabulary AS (SELECT DISTINCT term AS word FROM p0 UNION SELECT unnest([{words(ASKED)}])),
{_porter().strip()},
p AS (SELECT doc_id, zone, stem AS term, pos FROM p0 JOIN stems ON word = term)"""
