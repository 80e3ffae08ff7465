"""Resolving citations to judgments: by key, by page range, by name; windows, appeals, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import spans
from lexmill.functions.text import COMMON_NAME_WORDS, GOVERNMENT_WORDS, body_offset, jaccard, party_tokens, side, without_furniture, year_of
from lexmill.session import materialise

# Fixed values of the resolver.
NEED, NEED_NO_YEAR, MARGIN, YEARS = 0.5, 0.75, 0.1, 1
STOP_SHARE, STOP_LEAST, RANGE_NAME = 0.02, 5, 0.3
SAME_PARTIES = 0.6
OFFICE_SIDE = r"(?i)^\s*(?:the\s+)?(?:state|union\s+of\s+india|government|govt|central\s+bureau|c\.?b\.?i|commissioner|collector|director|secretary|inspector|superintendent|nct|public\s+prosecutor)\b"
PATH_ID = r"^([0-9]{4})_([0-9]+)_([0-9]+)_([0-9]+)"
_SCR = r"S\.?\s?C\.?\s?R\.?\s*([0-9]{1,4})"
_SCC = r"S\.?\s?C\.?\s?C\.?\s*([0-9]{1,4})"


def reporter_key(raw: Column) -> Column:
    """The key of one citation as written, by expressions alone: SCR, SCC and AIR; NULL for anything else."""

    def key(name: str, pattern: str, volume: bool, supplement: str = "") -> Column:
        year = F.nullif(F.regexp_extract(raw, pattern, 1), F.lit(""))
        vol = F.regexp_extract(raw, pattern, 2).cast("int").cast("string") if volume else F.lit("SC")
        return F.when(year.isNotNull(), F.concat(F.lit(f"{name}|"), year, F.lit("|"), vol, F.lit(f"|{supplement}|"), F.regexp_extract(raw, pattern, 3 if volume else 2).cast("int").cast("string")))

    ways = []
    for name, tail in (("SCR", _SCR), ("SCC", _SCC)):
        ways.append(key(name, rf"([0-9]{{4}})\s+Supp\.?\s*\(([0-9]{{1,2}})\)\s*{tail}", True, "S"))
        ways.append(key(name, rf"[\(\[]([0-9]{{4}})[\)\]]\s*([0-9]{{1,2}})\s*{tail}", True))
        ways.append(key(name, rf"([0-9]{{4}})\s*\(([0-9]{{1,2}})\)\s*{tail}", True))
    ways.append(key("AIR", r"A\.?I\.?R\.?\s*([0-9]{4})\s*S\.?C\.?\s*([0-9]{1,5})", False))
    return F.coalesce(*ways)


def corpus_keys(judgments: DataFrame) -> DataFrame:
    """(key, doc_id): keys that name exactly one judgment, from its citations and its id."""
    cited = judgments.select("doc_id", F.explode("reporter_citations").alias("raw")).select("doc_id", reporter_key(F.col("raw")).alias("key"))
    own = judgments.filter(F.col("doc_id").rlike(PATH_ID)).select("doc_id", F.concat_ws("|", F.lit("SCR"), F.regexp_extract("doc_id", PATH_ID, 1), F.regexp_extract("doc_id", PATH_ID, 2).cast("int").cast("string"), F.lit(""), F.regexp_extract("doc_id", PATH_ID, 3).cast("int").cast("string")).alias("key"))
    keys = cited.union(own).filter("key is not null").distinct()
    return keys.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")


def by_key(mentions: DataFrame, keys: DataFrame) -> DataFrame:
    """(mention_id, doc_id) of mentions whose key names one judgment."""
    return mentions.join(keys, "key").groupBy("mention_id").agg(F.min("doc_id").alias("doc_id"), F.countDistinct("doc_id").alias("n")).filter("n = 1").drop("n")


def page_ranges(judgments: DataFrame) -> DataFrame:
    """(year, volume, first, last, doc_id) from the ids."""
    part = lambda i: F.regexp_extract("doc_id", PATH_ID, i).cast("int")
    return judgments.filter(F.col("doc_id").rlike(PATH_ID)).select(part(1).alias("year"), part(2).alias("volume"), part(3).alias("first"), part(4).alias("last"), "doc_id").distinct()


def by_range(mentions: DataFrame, ranges: DataFrame) -> DataFrame:
    """(mention_id, doc_id): the volume's last range that begins at or before the page, if it holds it.

    An as-of join by one window over the ranges and the distinct pages asked
    for, sorted by page inside a volume, so a page that a third of all mentions
    cite is one row there; mentions then meet their page.
    """
    parts = F.split("key", r"\|")
    page = [parts[1].cast("int").alias("year"), parts[2].cast("int").alias("volume"), parts[4].cast("int").alias("page")]
    asked = mentions.filter(F.col("key").rlike(r"^SCR\|[0-9]+\|[0-9]+\|\|")).select("mention_id", *page)
    none = F.lit(None).cast("struct<last:int,doc_id:string>").alias("r")
    both = ranges.select("year", "volume", F.col("first").alias("page"), F.lit(0).alias("kind"), F.struct("last", "doc_id").alias("r")).unionByName(asked.select("year", "volume", "page").distinct().select("year", "volume", "page", F.lit(1).alias("kind"), none))
    order = Window.partitionBy("year", "volume").orderBy("page", "kind", F.col("r.last"), F.col("r.doc_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = both.withColumn("near", F.last("r", ignorenulls=True).over(order)).filter((F.col("kind") == 1) & (F.col("page") <= F.col("near.last")))
    return asked.join(hit.select("year", "volume", "page", F.col("near.doc_id").alias("doc_id")), ["year", "volume", "page"]).select("mention_id", "doc_id")


def title_stopwords(titles: DataFrame) -> DataFrame:
    """(token, df): title words in at least 5 titles and more than 2 % of them."""
    n = titles.agg(F.countDistinct("doc_id").alias("n"))
    df = titles.select("doc_id", F.explode(party_tokens(F.col("title"))).alias("token")).groupBy("token").agg(F.countDistinct("doc_id").alias("df"))
    return df.filter((F.col("df") >= STOP_LEAST) & (F.col("df") > STOP_SHARE * n.scalar())).select("token", "df")


def by_name(names: DataFrame, titles: DataFrame, year: str | None = None) -> DataFrame:
    """(mention_id, doc_id, score): the best title by shared party words, ahead of the next by a margin.

    ``year`` names the column of the mention's year: titles of years near it are
    candidates; without one, or where it is NULL, more words must be shared.
    Two word sets that share enough of their words share one of the rarest few
    of either, so only these are join keys (prefix filtering): a word that many
    titles have is a key only of titles that have no rarer one.
    """
    stop = title_stopwords(titles).select("token")
    least = NEED if year else NEED_NO_YEAR
    asked = names.select("mention_id", F.col("name").alias("text"), (F.col(year) if year else F.lit(None).cast("int")).alias("y"))
    known = titles.select("doc_id", F.col("title").alias("text"), (F.col("year") if year else F.lit(None).cast("int")).alias("ty"))
    counts = known.select("doc_id", F.explode(party_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))

    def split(df: DataFrame, id_: str, keep: str) -> DataFrame:
        t = df.select(id_, keep, party_tokens(F.col("text")).alias("full"))
        rare = t.select(id_, F.explode("full").alias("token")).join(F.broadcast(stop), "token", "left_anti").join(counts, "token", "left")
        ranked = rare.groupBy(id_).agg(F.transform(F.array_sort(F.collect_set(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))), lambda x: x["token"]).alias("rare"))
        return t.join(ranked, id_)

    prefix = lambda c: F.explode(F.slice(c, 1, F.size(c) - F.ceil(F.size(c) * least).cast("int") + 1)).alias("token")
    m, t = split(asked, "mention_id", "y"), split(known, "doc_id", "ty").withColumnsRenamed({"full": "tfull", "rare": "trare"})
    pairs = m.select("mention_id", prefix(F.col("rare"))).join(t.select("doc_id", prefix(F.col("trare"))), "token").select("mention_id", "doc_id").distinct()
    need = F.when(F.col("y").isNull(), NEED_NO_YEAR).otherwise(NEED)
    near = F.col("y").isNull() | (F.abs(F.col("y") - F.col("ty")) <= YEARS)
    scored = pairs.join(m, "mention_id").join(t, "doc_id").filter(F.coalesce(near, F.lit(False)) & (jaccard(F.col("rare"), F.col("trare")) >= need)).withColumn("score", jaccard(F.col("full"), F.col("tfull")))
    order = Window.partitionBy("mention_id").orderBy(F.desc("score"), F.desc("doc_id"))
    best = scored.withColumn("next", F.coalesce(F.lead("score").over(order), F.lit(0.0))).withColumn("rn", F.row_number().over(order)).filter("rn = 1")
    return best.filter((F.col("score") >= need) & (F.col("score") - F.col("next") >= MARGIN)).select("mention_id", "doc_id", F.round("score", 4).alias("score"))


def resolved(mentions: DataFrame, keys: DataFrame, ranges: DataFrame, titles: DataFrame) -> DataFrame:
    """(mention_id, doc_id, method, score): key, else page range with a name that agrees, else name, else none.

    ``mentions``: (mention_id, keys array, name, year), one row each; ``titles``:
    (doc_id, title, year).  Parallel citations that name different judgments
    decide nothing.  A range catches misprinted pages too, so it needs a cited
    name that agrees with the title; where it has none the name step follows.
    Mentions are resolved once per distinct (keys, name, year).
    """
    what = ["keys", "name", "year"]
    kinds = mentions.select(*what).distinct().withColumn("mention_id", F.xxhash64(F.concat_ws("\u001f", F.concat_ws("\u001e", "keys"), F.coalesce("name", F.lit("\u0000")), F.coalesce(F.col("year").cast("string"), F.lit("")))))
    kinds = materialise(kinds, "mention-kinds")
    cited = kinds.select("mention_id", F.explode(F.array_distinct("keys")).alias("key"))

    def agreed(votes: DataFrame, name: str) -> DataFrame:
        return votes.groupBy("mention_id").agg(F.min("doc_id").alias(name), F.countDistinct("doc_id").alias(f"n_{name}"))

    table = kinds.join(agreed(cited.join(keys, "key"), "k"), "mention_id", "left").join(agreed(by_range(cited, ranges), "r"), "mention_id", "left")
    table = table.join(titles.select(F.col("doc_id").alias("r"), F.col("title").alias("range_title")), "r", "left")
    agrees = F.coalesce(jaccard(party_tokens(F.col("name")), party_tokens(F.col("range_title"))) >= RANGE_NAME, F.lit(False))
    by_cite = F.when(F.col("n_k") == 1, F.struct(F.col("k").alias("doc_id"), F.lit("cite").alias("method")))
    ranged = F.when(F.col("n_k").isNull() & (F.col("n_r") == 1) & agrees, F.struct(F.col("r").alias("doc_id"), F.lit("scr_range").alias("method")))
    table = materialise(table.select("mention_id", *what, F.coalesce(by_cite, ranged).alias("hit")), "by-cite")
    open_ = table.filter(F.col("hit").isNull() & (F.col("name") != ""))
    named = by_name(open_.select("mention_id", "name", "year"), titles, "year").withColumnRenamed("doc_id", "n")
    done = table.join(named, "mention_id", "left").select(
        *what,
        F.coalesce("hit.doc_id", "n").alias("doc_id"),
        F.coalesce("hit.method", F.when(F.col("n").isNotNull(), "name"), F.lit("none")).alias("method"),
        F.when(F.col("hit").isNotNull(), 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    ).withColumnsRenamed({c: f"_{c}" for c in what})
    same = [mentions[c].eqNullSafe(done[f"_{c}"]) for c in what]
    return mentions.join(done, same).select("mention_id", "doc_id", "method", "score")


def cascade(mentions: DataFrame, keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """(mention_id, doc_id, method): key, else page range, else none."""
    a = by_key(mentions, keys).withColumnRenamed("doc_id", "k")
    b = by_range(mentions, ranges).withColumnRenamed("doc_id", "r")
    all_ = mentions.select("mention_id").distinct().join(a, "mention_id", "left").join(b, "mention_id", "left")
    return all_.select("mention_id", F.coalesce("k", "r").alias("doc_id"), F.when(F.col("k").isNotNull(), "cite").when(F.col("r").isNotNull(), "scr_range").otherwise("none").alias("method"))


def private_tokens(title: Column) -> Column:
    """Party words of the sides that are no office."""
    parts = [F.when(side(title, i).isNotNull() & ~side(title, i).rlike(OFFICE_SIDE), side(title, i)) for i in (1, 2)]
    return party_tokens(F.concat_ws(" ", *parts))


def same_parties(a: Column, b: Column) -> Column:
    """The same dispute: the private sides share most words, in either order."""
    x, y = private_tokens(a), private_tokens(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & (jaccard(x, y) >= SAME_PARTIES)


def own_title(title: Column, name: Column) -> Column:
    """A mention that repeats the judgment's own title: it holds every private word of it."""
    x = private_tokens(title)
    return (F.size(x) > 0) & (F.size(F.array_except(x, party_tokens(name))) == 0)


# Words that tell that a decision is under appeal, and that one was reversed.
UNDER_APPEAL = r"(?i)\bimpugned\s+(?:judgment|order|decision|common\s+judgment|final\s+judgment)|\b(?:judgment|order|decision)\s+under\s+(?:appeal|challenge)|\bappeals?\s+(?:is\s+|are\s+)?(?:directed\s+)?against\s+the\s+(?:judgment|order)"
REVERSED = r"(?i)\bset\s+aside\b|\breversed\b|\bquashed\b"


def _private(title: Column) -> Column:
    return F.array_except(private_tokens(title), F.array(*map(F.lit, GOVERNMENT_WORDS)))


def running_header(title: Column, name: Column, common: Column) -> Column:
    """The judgment's own title however it is printed: every telling private word of it (or, without any, every word of
    it) is in the mention, and the mention's other side opens with a word of the title or its initials, if both have one."""
    plain = F.concat(F.array(*map(F.lit, COMMON_NAME_WORDS)), common)
    telling = F.array_except(_private(title), plain)
    words = F.when(F.size(telling) > 0, telling).otherwise(party_tokens(title))
    held = (F.size(words) > 0) & (F.size(F.array_except(words, party_tokens(name))) == 0)
    first = F.try_element_at(party_tokens(side(name, 2)), F.lit(1))
    initials = F.array_join(F.transform(F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.substring(w, 1, 1)), "")
    fits = first.isNull() | F.array_contains(party_tokens(title), first) | (F.size(F.coalesce(party_tokens(side(title, 2)), F.array().cast("array<string>"))) == 0) | ((F.length(first) > 1) & F.contains(initials, first))
    return F.coalesce(held & F.coalesce(fits, F.lit(True)), F.lit(False))


def appeal_history(context: Column, title: Column, cited: Column, supreme: Column, common: Column) -> Column:
    """The cited decision is an earlier round of the same dispute (the private sides agree in most words, one of them
    telling), or one of another court that the mention's own sentence calls impugned or reversed."""
    x, y = _private(title), _private(cited)
    shared = F.array_except(F.array_intersect(x, y), F.concat(F.array(*map(F.lit, COMMON_NAME_WORDS)), common))
    same = (jaccard(x, y) >= SAME_PARTIES) & (F.size(shared) > 0)
    return F.coalesce(same, F.lit(False)) | (~supreme & (F.coalesce(context.rlike(UNDER_APPEAL) | context.rlike(REVERSED), F.lit(False))))


#: Reporters that print one court's judgments only.
_SUPREME_KEY = r"^(?:SCC|SCR|INSC|SCALE|JT)\||^[A-Z_]+\|[0-9]+\|SC\|"


def built(judgments: DataFrame) -> DataFrame:
    """(citing_doc, start, end, kind, cited_raw, keys, cited_doc, method, score, window, is_self, appeal_history, in_headnote, citing_bench, cited_bench).

    Every mention in every text, resolved against the collection.
    ``judgments``: (doc_id, title, year, bench, text, reporter_citations), one
    row per document.  Offsets are those of the text without page furniture.
    Texts are read once; NULL and empty ones have no mentions.  The titles'
    frequent words, which are no evidence, are at most 1 / STOP_SHARE words a
    title and go along as one value.
    """
    clean = judgments.filter(F.col("text").isNotNull()).select("doc_id", without_furniture(F.col("text")).alias("text"))
    ddl = "start int, end int, kind string, cited_raw string, own array<string>, antecedent int, name string, keys array<string>, window string, context string"
    found = spans.spans(clean, "doc_id", "text", spans.windows, ddl)
    year = F.array_min(F.transform("keys", lambda k: F.split(k, r"\|")[1].cast("int")))
    found = materialise(found.withColumn("mention_id", F.concat_ws("|", "key", "start", "end")).withColumn("year", year), "mentions")
    titles = judgments.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), "year", "bench")
    done = resolved(found.select("mention_id", "keys", "name", "year"), corpus_keys(judgments), page_ranges(judgments), titles)
    common = F.coalesce(title_stopwords(titles).agg(F.collect_list("token")).scalar(), F.array().cast("array<string>"))
    heads = clean.select(F.col("doc_id").alias("key"), body_offset(F.col("text")).alias("headnote_end"))
    rows = found.join(done, "mention_id").join(heads, "key")
    rows = rows.join(titles.select(F.col("doc_id").alias("key"), F.col("title").alias("citing_title"), F.col("bench").alias("citing_bench")), "key")
    rows = rows.join(titles.select("doc_id", F.col("title").alias("cited_title"), F.col("bench").alias("cited_bench")), "doc_id", "left").withColumn("common", common)
    supreme = F.col("doc_id").isNotNull() | (F.size("keys") == 0) | F.exists("keys", lambda k: k.rlike(_SUPREME_KEY))
    header = F.col("doc_id").isNull() & (F.size("keys") == 0) & running_header(F.col("citing_title"), F.col("name"), F.col("common"))
    rows = rows.withColumn("is_self", F.coalesce(F.col("doc_id") == F.col("key"), F.lit(False)) | header)
    appeal = ~F.col("is_self") & appeal_history(F.col("context"), F.col("citing_title"), F.coalesce("cited_title", "name"), supreme, F.col("common"))
    return rows.select(
        F.col("key").alias("citing_doc"), "start", "end", "kind", "cited_raw", "keys", F.col("doc_id").alias("cited_doc"), "method", "score", "window",
        "is_self", appeal.alias("appeal_history"), (F.col("start") < F.col("headnote_end")).alias("in_headnote"), "citing_bench", "cited_bench",
    )


def report(resolved: DataFrame) -> DataFrame:
    """Mentions and resolved ones by method, with a total."""
    return resolved.rollup("method").agg(F.count(F.lit(1)).alias("mentions"), F.count("doc_id").alias("resolved"), F.countDistinct("citing_doc", "doc_id").alias("edges"), F.grouping_id().cast("int").alias("level"))


def with_year(names: DataFrame) -> DataFrame:
    return names.withColumn("year", year_of(F.col("name")))
