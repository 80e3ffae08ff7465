"""The catalogue of published judgments: dedup, search, selection, plans, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions.text import catalog_date, smart_title

# What makes a title or a text look like a criminal matter, and the least length of a readable text.
CRIMINAL_TITLE = r"(?i)\bSTATE\b|CENTRAL BUREAU|\bC\.?B\.?I\b|NARCOTIC|ENFORCEMENT|POLICE|UNION TERRITORY|\bN\.?C\.?T\b|SPECIAL CELL|INTELLIGENCE|CUSTOMS|NATIONAL INVESTIGATION|\bN\.?I\.?A\b|DIRECTORATE|CRIMINAL|GOVT\. OF|GOVERNMENT OF"
CRIMINAL_TEXT = r"(?i)(?<!\w)(?:IPC|I\.P\.C\.|Indian\s+Penal\s+Code|Penal\s+Code|BNS|Bharatiya\s+Nyaya\s+Sanhita|CrPC|Cr\.\s?P\.\s?C\.|Code\s+of\s+Criminal\s+Procedure|BNSS|Bharatiya\s+Nagarik\s+Suraksha\s+Sanhita|NDPS|Narcotic\s+Drugs|Prevention\s+of\s+Corruption|UAPA|Unlawful\s+Activities|POCSO|Protection\s+of\s+Children\s+from\s+Sexual|Arms\s+Act|Dowry\s+Prohibition)(?!\w)"
LEAST_CHARS = 1500


def first_per_path(entries: DataFrame) -> DataFrame:
    """One entry per path: the one with a document, then by title; the order is part of the result, not of the input."""
    order = Window.partitionBy("path").orderBy(F.col("pdf_bytes").isNull(), F.desc("pdf_bytes"), "title")
    return entries.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def find(entries: DataFrame, words: list[str], years: list[int] | None = None) -> DataFrame:
    """Entries whose title has every word, whatever the case."""
    for w in words:
        entries = entries.filter(F.lower("title").contains(w.lower()))
    return entries.filter(F.col("case_year").isin(years)) if years else entries


def is_criminal_title(title: Column) -> Column:
    return title.rlike(CRIMINAL_TITLE)


def is_criminal_text(text: Column) -> Column:
    return text.rlike(CRIMINAL_TEXT)


def candidates(entries: DataFrame, years: list[int], tier: str = "criminal-title") -> DataFrame:
    """Entries of the years that have a document and, in that tier, a criminal-looking title."""
    keep = F.col("case_year").isin(years) & F.col("pdf_bytes").isNotNull()
    return entries.filter(keep & is_criminal_title(F.col("title")) if tier == "criminal-title" else keep)


def named_matches(entries: DataFrame, named: list[tuple[str, list[int], str]]) -> DataFrame:
    """(label, path): entries that match a stated list of (label, years, title pattern); each entry meets the list on its own."""
    each = F.explode(F.array(*[F.struct(F.lit(lab).alias("label"), (F.col("case_year").isin(years) & F.col("title").rlike(pat)).alias("hit")) for lab, years, pat in named]))
    return entries.filter("pdf_bytes is not null").select("path", each.alias("n")).filter("n.hit").select(F.col("n.label").alias("label"), "path")


def fetch_plan(first: DataFrame, then: DataFrame) -> DataFrame:
    """Both lists, an entry once, newest year first."""
    both = first.select("path", "case_year", F.lit(0).alias("src")).union(then.select("path", "case_year", F.lit(1)))
    return both.groupBy("path", "case_year").agg(F.min("src").alias("src"))


def still_to_fetch(planned: DataFrame, done: DataFrame) -> DataFrame:
    return planned.join(done.select("path"), "path", "left_anti")


def status(entries: DataFrame, read: DataFrame, years: int = 30) -> DataFrame:
    """Per year: entries, documents, criminal titles, already read; the newest years."""
    e = entries.join(read.select("path", F.lit(1).alias("read")).distinct(), "path", "left")
    return e.groupBy("case_year").agg(F.count(F.lit(1)).alias("entries"), F.count("pdf_bytes").alias("documents"), F.count_if(is_criminal_title(F.col("title"))).alias("criminal"), F.count("read").alias("read")).orderBy(F.desc("case_year")).limit(years)


def corpus(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """Entries with their text and the reason to leave them out (NULL: kept)."""
    j = entries.withColumn("doc_id", F.concat("path", F.lit("_EN"))).join(texts, "doc_id", "left")
    reason = (
        F.when(F.col("text").isNull(), "no text")
        .when(F.length("text") < LEAST_CHARS, "short")
        .when(~is_criminal_text(F.col("text")), "not criminal")
        .when(catalog_date(F.col("decision_date")).isNull(), "bad record")
    )
    return j.withColumn("reason", reason).withColumn("new_title", smart_title(F.col("title")))


def check_replacement(new_rows: int, old_rows: int) -> None:
    """Refuse to replace a corpus by nothing or by less than half of it."""
    if new_rows == 0 or new_rows * 2 < old_rows:
        raise ValueError(f"refusing to replace {old_rows} rows by {new_rows}")


def manifest(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row (rows, digest) that changes with any row but not with their order."""
    h = F.xxhash64(key, *columns)
    # The sum too, as two equal rows cancel in the exclusive or.
    both = F.xxhash64(F.bit_xor(h), F.sum(h.cast("decimal(38,0)")))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.when(F.count(F.lit(1)) > 0, both).alias("digest"))
