"""Text as Column expressions: citation spelling, tokens, titles, dates, parties, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern, the abbreviations kept whole and the English stop list.
TOKEN = r"[a-z]+(?:-[a-z0-9]+)*|[0-9]+[a-z]*(?:-[a-z0-9]+)*"
LEGAL = ["ipc", "bns", "crpc", "bnss", "cpc", "fir", "scc", "scr", "insc", "sc", "jj"]
LEGAL_NUMBER = r"^([0-9]+[a-z]?(-[0-9]+)?[a-z]?|[0-9]{4}[a-z]+)$"
STOP = (
    "a about above after again against ain all am an and any are aren as at be because been before being below between both but by can couldn d did didn do does doesn doing don down during each few for "
    "from further had hadn has hasn have haven having he her here hers herself him himself his how i if in into is isn it its itself just ll m ma me mightn more most mustn my myself needn no nor not now o of off on once only "
    "or other our ours ourselves out over own re s same shan she should shouldn so some such t than that the their theirs them themselves then there these they this those through to too under until up ve very was wasn we "
    "were weren what when where which while who whom why will with won wouldn y you your yours yourself yourselves"
).split()
PARTY_STOP = (
    "v vs versus and the of in re ors anr others another etc thr through rep represented by its m s ms mr mrs dr ltd pvt private limited co company sri shri smt kumari km alias a an for to on at with sq ldr retd"
).split()
COMMON_NAME_WORDS = (
    "singh kumar lal ram devi prasad das khan ali ahmed ahmad mohd mohammad mohammed sharma gupta verma yadav reddy rao "
    "nair pillai patel shah jain mishra tiwari pandey chand nath bai begum bibi sahu babu raj kumari rani shri sri "
    "state union india court high supreme government board commissioner corporation bank company municipal council "
    "limited private public society trust india's"
).split()
GOVERNMENT_WORDS = "state union india government govt central public prosecutor cbi nct".split()
ACRONYMS = ["ipc", "bns", "cbi", "ii", "iii", "iv", "ltd.", "u.p.", "m.p."]
SMALL_WORDS = ["of", "and", "the", "for", "in", "v.", "by", "on", "to"]


def spelled(text: Column) -> Column:
    """Reporter citations and codes in one spelling: [2025] and S.C.R. become 2025 and SCR."""
    t = F.regexp_replace(text, r"\[([0-9]{4})\]", "$1")
    for dotted, plain in ((r"(?i)\bS\.C\.R\.", "SCR"), (r"(?i)\bS\.C\.C\.", "SCC"), (r"(?i)\bI\.N\.S\.C\.", "INSC"), (r"(?i)\bCr\.\s*P\.?\s*C\.", "CrPC")):
        t = F.regexp_replace(t, dotted, plain)
    return t


def is_legal(token: Column) -> Column:
    """Whether a token is kept whole: an abbreviation, a number or a section."""
    return token.isin(LEGAL) | token.rlike(LEGAL_NUMBER)


def tokens(text: Column) -> Column:
    """Lower-case tokens in order without stop words, not stemmed; NULL and empty texts have none."""
    found = F.regexp_extract_all(F.lower(spelled(F.coalesce(text, F.lit("")))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: is_legal(t) | ~t.isin(STOP))


def clean_zone(text: Column) -> Column:
    """Line ends as LF, blanks collapsed, at most one empty line."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+", " ")
    return F.trim(F.regexp_replace(t, "\n{3,}", "\n\n"))


def without_controls(text: Column) -> Column:
    """Form feeds as line ends, soft hyphens and control characters gone, blanks plain."""
    t = F.translate(text, "\f ­", "\n ")
    return F.regexp_replace(F.regexp_replace(t, "[\u0000-\u0008\u000b\u000e-\u001f\u007f]", ""), "[ \t]{2,}", " ")


def without_furniture(text: Column) -> Column:
    """Margin letters, page numbers and running heads dropped line by line, words rejoined, blanks collapsed."""
    noise = r"^\s*([A-H]|[0-9]{1,4}|SUPREME COURT REPORTS|\[[0-9]{4}\]\s*[0-9]{1,2}\s+S\.C\.R\.(\s+[0-9]{1,4})?)\s*$"
    lines = F.filter(F.split(text, "\n"), lambda ln: ~ln.rlike(noise))
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"(\w)-\n(\w)", "$1-$2"), r"\s+", " "))


def iso_date(text: Column) -> Column:
    """A date written dd-MM-yyyy, yyyy-MM-dd, dd.MM.yyyy, dd/MM/yyyy or d MMMM yyyy; NULL for anything else."""
    t = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "dd-MM-yyyy", "dd.MM.yyyy", "dd/MM/yyyy", "d MMMM yyyy")])


def catalog_date(text: Column) -> Column:
    """A dd-MM-yyyy date as ISO text, else NULL."""
    return F.date_format(F.try_to_timestamp(F.trim(text), F.lit("dd-MM-yyyy")), "yyyy-MM-dd")


def year_of(text: Column) -> Column:
    """The first year from 1800 to 2099 in a text."""
    return F.nullif(F.regexp_extract(text, r"\b(1[89][0-9]{2}|20[0-9]{2})\b", 1), F.lit("")).cast("int")


def smart_title(raw: Column) -> Column:
    """Case names in title case: ``versus`` as ``v.``, acronyms and initials in capitals, small words small."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?i)\bversus\b|\bvs\.?(?=\s)", "v."), r"\s+", " ")), " ")

    def one(word: Column, at: Column) -> Column:
        low = F.lower(word)
        return (
            F.when(low == "v.", low)
            .when(low.isin(ACRONYMS) & (low != "ltd."), F.upper(word))
            .when(low.rlike(r"^([a-z]\.)+$"), F.upper(word))
            .when((at > 0) & low.isin(SMALL_WORDS), low)
            .otherwise(F.initcap(low))
        )

    return F.array_join(F.transform(words, one), " ")


def party_tokens(name: Column) -> Column:
    """Telling words of a case name as a set: no connectors, single letters or numbers."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.rlike("^[0-9]+$") & ~t.isin(PARTY_STOP)))


def side(title: Column, index: int) -> Column:
    """Petitioner (1) or respondent (2) of a case name; NULL where there is none."""
    return F.try_element_at(F.split(title, r"(?i)\s+(?:v\.?|vs\.?|versus|v/s)\s+", 2), F.lit(index))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; 0 if both are empty or one is NULL."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)).cast("double"), F.lit(0.0)), F.lit(0.0))


def base_section(section: Column) -> Column:
    """438(1) and 120-B as 438 and 120B."""
    return F.upper(F.regexp_replace(F.regexp_replace(section, r"\(.*$", ""), r"[^A-Za-z0-9]", ""))


def normal_act(act: Column, date: Column) -> Column:
    """A code as written as IPC, BNS, CRPC or BNSS; ``the Code`` by the date, CRPC without one."""
    a = F.regexp_replace(F.upper(act), r"[.\s]", "")
    has = a.contains
    return (
        F.when(has("BNSS") | has("NAGARIK"), "BNSS")
        .when(has("BNS") | has("NYAYA"), "BNS")
        .when(has("IPC") | has("PENAL"), "IPC")
        .when(has("CRPC") | has("PROCEDURE"), "CRPC")
        .when(has("CODE"), F.when(date >= F.lit("2024-07-01").cast("date"), "BNSS").otherwise("CRPC"))
        .when(a.isNotNull(), "UNKNOWN")
    )


def window_id(citing: Column, start: Column, end: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", citing, start.cast("string"), end.cast("string"))), 1, 12)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def safe_cell(text: Column) -> Column:
    """A spreadsheet cell that no program takes for a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def excerpt(text: Column, limit: int = 500) -> Column:
    """Blanks collapsed and the text cut at ``limit`` with an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("..."))).otherwise(t)


def doc_label(title: Column, date: Column, bench: Column) -> Column:
    """``Title (date, n-judge bench)`` from what is there."""
    inner = F.concat_ws(", ", date.cast("string"), F.concat(bench.cast("string"), F.lit("-judge bench")))
    return F.concat(F.coalesce(title, F.lit("")), F.when(inner != "", F.concat(F.lit(" ("), inner, F.lit(")"))).otherwise(""))


def parse_grade(raw: Column) -> Column:
    """A grade cell: empty is NULL, 2.0 is 2, anything else than 0, 1, 2 is NULL too (see ``bad_grade``)."""
    whole = F.nullif(F.trim(raw), F.lit("")).try_cast("double")
    return F.when(whole.isin(0.0, 1.0, 2.0), whole.cast("int"))


def bad_grade(raw: Column) -> Column:
    return (F.trim(raw) != "") & parse_grade(raw).isNull()


def marked_window(text: Column, start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """The text from ``lo`` to ``hi`` with the mention from ``start`` to ``end`` between double brackets; offsets from 0."""
    part = lambda a, b: F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))
    return F.concat(part(lo, start), F.lit("[["), part(start, end), F.lit("]]"), part(end, hi))


def local_context(window: Column, reach: int = 150) -> Column:
    """The marked mention with ``reach`` characters on either side, without its marks."""
    at = F.instr(window, "[[")
    stop = F.instr(window, "]]")
    first = F.greatest(at - reach, F.lit(1))
    return F.when((at > 0) & (stop > at), F.replace(F.replace(F.substring(window, first, stop + 2 + reach - first), F.lit("[["), F.lit("")), F.lit("]]"), F.lit("")))


def body_offset(text: Column) -> Column:
    """Where the first line on jurisdiction begins, from 0; 0 without one."""
    return F.greatest(F.regexp_instr(text, F.lit(r"\b(?:CRIMINAL|CIVIL|APPELLATE|ORIGINAL|ADVISORY|EXTRAORDINARY|INHERENT)(?:\s+[A-Z]{4,})?\s+JURISDICTION\b")) - 1, F.lit(0))


def content_terms(query: Column, most: int = 6) -> Column:
    """The first telling words of a query, each once."""
    return F.slice(F.array_distinct(F.filter(tokens(query), lambda t: ~t.rlike("^[0-9]"))), 1, most)


def section_numbers(query: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(query, F.lit(r"\b([0-9]{1,4}[A-Za-z]?)\b"), F.lit(1)))


def years(spec: str) -> list[int]:
    """``2025-2015,2012`` as years, ranges in the direction written."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        a, _, b = part.partition("-")
        lo, hi = int(a), int(b or a)
        out += range(lo, hi + 1) if lo <= hi else range(lo, hi - 1, -1)
    return out
