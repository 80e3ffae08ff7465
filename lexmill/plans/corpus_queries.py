"""Catalogue, text functions and citation resolution over entries, judgments, resolutions and name spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import spans as sp
from lexmill.functions import text as tx
from lexmill.operators import catalog as ca
from lexmill.operators import citations as ci
from lexmill.session import load

NAMED = [("excise", list(range(1950, 2030)), r"(?i)commissioner of excise"), ("stamps", list(range(1990, 2030)), r"(?i)collector of stamps"), ("kesholi", [2014, 2015, 2016], r"(?i)kesholi")]
YEARS = list(range(2000, 2026))
#: White space as a browser knows it, for a character class.
SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "entries").filter("path is not null")


def _texts(spark, sf) -> DataFrame:
    return load(spark, sf, "judgments").filter("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("title").alias("title_"))


def _titles(spark, sf) -> DataFrame:
    m = load(spark, sf, "doc_meta").filter("doc_id is not null and title is not null")
    return m.groupBy("doc_id").agg(F.min("title").alias("title"), F.min("case_year").alias("year"))


def _read(spark, sf) -> DataFrame:
    return load(spark, sf, "judgments").select(F.regexp_replace("doc_id", "_EN$", "").alias("path")).distinct()


def catalog_dedup(spark, sf):
    """S7, S10."""
    return ca.first_per_path(_entries(spark, sf)).select("path", "case_year", "title", "pdf_bytes")


def title_search(spark, sf):
    """S11."""
    return ca.find(_entries(spark, sf), ["state", "kesholi"], YEARS).select("path", "title").distinct()


def criminal_titles(spark, sf):
    """P2, P4."""
    return ca.candidates(_entries(spark, sf), YEARS).select("path", "case_year").distinct()


def named_cases(spark, sf):
    """P11."""
    return ca.named_matches(_entries(spark, sf), NAMED).distinct()


def fetch_plan(spark, sf):
    """S19."""
    e = _entries(spark, sf)
    return ca.fetch_plan(ca.candidates(e, YEARS), e.filter("pdf_bytes > 1000000")).select("path", "case_year")


def fetch_todo(spark, sf):
    """Planned but not read."""
    return ca.still_to_fetch(ca.first_per_path(_entries(spark, sf)), _read(spark, sf)).select("path")


def corpus_status(spark, sf):
    """S20."""
    return ca.status(ca.first_per_path(_entries(spark, sf)), _read(spark, sf))


def corpus_skip_reasons(spark, sf):
    """S14, P3, T13."""
    c = ca.corpus(ca.first_per_path(_entries(spark, sf)), _texts(spark, sf))
    return c.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def doc_meta_table(spark, sf):
    """Labels of all judgments."""
    m = load(spark, sf, "doc_meta").filter("doc_id is not null").select("doc_id", "title", "case_year", "bench").distinct()
    return m.select("doc_id", tx.doc_label(F.col("title"), F.col("case_year"), F.col("bench")).alias("label"))


def manifest(spark, sf):
    """Rows and digest of the catalogue."""
    return ca.manifest(_entries(spark, sf).distinct(), "path", "title", "decision_date")


def schema_violations(spark, sf):
    """Judgments that break their schema: no id, no ISO date, a bench below 1 or unlike its judges, unknown zones."""
    j = load(spark, sf, "judgments").select("doc_id", "decision_date", "bench_size", F.size("judges").alias("n_judges"), F.map_keys("zones").alias("z"))
    problem = F.explode(
        F.array_compact(
            F.array(
                F.when(F.coalesce(F.trim("doc_id"), F.lit("")) == "", "no id"),
                F.when(F.to_date(F.try_to_timestamp("decision_date", F.lit("yyyy-MM-dd"))).isNull(), "date"),
                F.when(F.col("bench_size") < 1, "bench"),
                F.when((F.col("bench_size") != F.col("n_judges")) & (F.col("n_judges") > 0), "bench and judges"),
                F.when(F.size(F.array_except("z", F.array(*map(F.lit, ["headnote", "facts", "arguments", "holding"])))) > 0, "zone"),
            )
        )
    )
    return j.select("doc_id", problem.alias("problem")).distinct()


def catalog_dates(spark, sf):
    """T13, T34."""
    e = _entries(spark, sf).select("path", "decision_date", "citation").distinct()
    return e.select("path", tx.catalog_date(F.col("decision_date")).alias("iso"), tx.year_of(F.col("citation")).alias("year"))


def titles_cased(spark, sf):
    """Catalogue titles in title case."""
    return _entries(spark, sf).select("path", tx.smart_title(F.col("title")).alias("title")).distinct()


def party_sets(spark, sf):
    """Words of each side and how much the sides share."""
    t = _titles(spark, sf)
    a, b = tx.party_tokens(tx.side(F.col("title"), 1)), tx.party_tokens(tx.side(F.col("title"), 2))
    return t.select("doc_id", F.array_join(F.array_sort(tx.party_tokens(F.col("title"))), " ").alias("tokens"), F.round(tx.jaccard(a, b), 6).alias("shared"))


def zones_cleaned(spark, sf):
    """Cleaned zones, by length, and their excerpts."""
    z = load(spark, sf, "judgments").select("doc_id", F.explode("zones").alias("zone", "text")).distinct()
    return z.select("doc_id", "zone", F.length(tx.clean_zone(F.col("text"))).alias("clean"), F.length(tx.excerpt(F.col("text"), 120)).alias("short"))


def furniture_dropped(spark, sf):
    """Scanned texts without page furniture, by length."""
    j = load(spark, sf, "judgments").filter("text_layer = 'scan' and text is not null").select("doc_id", "text").distinct()
    return j.select("doc_id", F.length(tx.without_furniture(tx.without_controls(F.col("text")))).alias("n"))


def cite_keys(spark, sf):
    """Keys of the citations as written."""
    r = load(spark, sf, "resolutions").select("mention_id", "cited_raw").distinct()
    return r.select("mention_id", ci.reporter_key(F.col("cited_raw")).alias("key"))


def _keyed(spark, sf) -> DataFrame:
    return cite_keys(spark, sf).filter("key is not null")


def _judged(spark, sf) -> DataFrame:
    return load(spark, sf, "judgments").filter("doc_id is not null").select("doc_id", "reporter_citations").distinct()


def cite_key_resolve(spark, sf):
    """C6, C7."""
    return ci.by_key(_keyed(spark, sf), ci.corpus_keys(_judged(spark, sf)))


def page_range_resolve(spark, sf):
    """C8."""
    return ci.by_range(_keyed(spark, sf), ci.page_ranges(_judged(spark, sf)))


def resolve_cascade(spark, sf):
    """C10."""
    j = _judged(spark, sf)
    return ci.cascade(_keyed(spark, sf), ci.corpus_keys(j), ci.page_ranges(j))


def _asked(spark, sf) -> DataFrame:
    """Names of spans with the citation of a resolution of the same citing judgment's number: every mention has a name and some a key."""
    r = load(spark, sf, "resolutions").select("mention_id", F.col("cited_raw")).distinct().groupBy("mention_id").agg(F.min(ci.reporter_key(F.col("cited_raw"))).alias("key"))
    n = _names(spark, sf).select("mention_id", "name")
    both = n.join(r, "mention_id", "full_outer")
    year = F.split("key", r"\|")[1].cast("int")
    return both.select("mention_id", F.when(F.col("key").isNull(), F.array().cast("array<string>")).otherwise(F.array("key")).alias("keys"), F.coalesce("name", F.lit("")).alias("name"), year.alias("year"))


def resolve_full(spark, sf):
    """Key, page range with a name that agrees, name, none."""
    j = _judged(spark, sf)
    return ci.resolved(_asked(spark, sf), ci.corpus_keys(j), ci.page_ranges(j), _titles(spark, sf)).select("mention_id", "doc_id", "method", F.round("score", 4).alias("score"))


def mention_build(spark, sf):
    """Every mention of every judgment, resolved, windowed, with its flags."""
    j = load(spark, sf, "judgments").filter("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("title").alias("title"), F.min("decision_date").alias("date"), F.max("bench_size").alias("bench"), F.first("reporter_citations", ignorenulls=True).alias("reporter_citations"))
    return ci.built(j.withColumn("year", tx.year_of(F.col("date")))).drop("window")


def title_stopwords(spark, sf):
    """C6."""
    return ci.title_stopwords(_titles(spark, sf))


def _names(spark, sf) -> DataFrame:
    return load(spark, sf, "name_spans").select(F.col("span_id").alias("mention_id"), "citing_doc", "name").distinct().filter("name is not null")


def name_jaccard_resolve(spark, sf):
    """C9."""
    return ci.by_name(_names(spark, sf).select("mention_id", "name"), _titles(spark, sf))


def appeal_history(spark, sf):
    """Names that repeat the parties of the citing judgment."""
    n = _names(spark, sf).join(_titles(spark, sf).select(F.col("doc_id").alias("citing_doc"), "title"), "citing_doc")
    return n.select("mention_id", ci.same_parties(F.col("title"), F.col("name")).alias("same"), ci.own_title(F.col("title"), F.col("name")).alias("own"))


def resolution_rollup(spark, sf):
    """C16."""
    return ci.report(load(spark, sf, "resolutions").select("mention_id", "citing_doc", "doc_id", "method").distinct())


def resolver_spot_check(spark, sf):
    """C17: resolved SCR citations against the cited judgment's own, by method."""
    r = load(spark, sf, "resolutions").select("mention_id", "cited_raw", "doc_id", "method").distinct().filter("doc_id is not null").withColumn("key", ci.reporter_key(F.col("cited_raw")))
    own = _judged(spark, sf).select("doc_id", F.explode("reporter_citations").alias("raw")).select("doc_id", ci.reporter_key(F.col("raw")).alias("key")).filter("key is not null").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    j = r.join(own, "doc_id", "left")
    state = F.when(F.col("key").isNull() | F.col("keys").isNull(), "unchecked").when(F.array_contains("keys", F.col("key")), "match").otherwise("mismatch")
    return j.groupBy("method", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def data_checks(spark, sf):
    """Shares of judgments with a bench, a citation and a page id."""
    j = load(spark, sf, "judgments").filter("doc_id is not null").groupBy("doc_id").agg(F.max("bench_size").alias("bench"), F.max(F.size("judges")).alias("nj"), F.max(F.size("reporter_citations")).alias("nc"))
    n = F.count(F.lit(1))
    return j.agg(*[F.round(F.count_if(c) / n, 6).alias(a) for a, c in (("bench_known", F.coalesce(F.col("bench") > 0, F.lit(False)) | F.coalesce(F.col("nj") > 1, F.lit(False))), ("reporter_key", F.coalesce(F.col("nc") > 0, F.lit(False))), ("path_doc_id", F.col("doc_id").rlike(ci.PATH_ID)))])


def found_cites(spark, sf):
    """Reporter citations in the texts, with offsets."""
    return sp.spans(_texts(spark, sf), "doc_id", "text", sp.find_cites, "start int, end int, cite string, court string")


def found_mentions(spark, sf):
    """Mentions with kind and antecedent."""
    return sp.spans(_texts(spark, sf), "doc_id", "text", sp.mentions, "start int, end int, kind string, raw string, keys array<string>, antecedent int").drop("keys")


def citation_windows(spark, sf):
    """The sentence around each name span with its neighbours, by offsets."""
    s = sp.spans(_texts(spark, sf), "doc_id", "text", sp.legal_sentences, "start int, end int")
    order = Window.partitionBy("key").orderBy("start")
    s = s.withColumn("lo", F.coalesce(F.lag("start").over(order), "start")).withColumn("hi", F.coalesce(F.lead("end").over(order), "end"))
    n = load(spark, sf, "name_spans").select("span_id", F.col("citing_doc").alias("key"), "span_start").distinct()
    return n.join(s, "key").filter((F.col("start") <= F.col("span_start")) & (F.col("span_start") < F.col("end"))).select("span_id", "lo", "hi")


def _plain(c):
    """Letters, with their marks, and digits of any script alone, lower-case, words a space apart."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", " "))


def _paragraphs(text):
    """The paragraphs of a text: at empty lines, in a long text with fewer than six of them at every line."""

    def parts(at):
        return F.filter(F.split(text, at), lambda p: p.rlike(rf"[^{SPACE}]"))

    blocks = parts(rf"\n[{SPACE}]*\n")
    return F.when((F.size(blocks) < 6) & (F.octet_length(F.encode(text, "UTF-16BE")) > 2 * 3000), parts(r"\n")).otherwise(blocks)


def evidence_located(spark, sf):
    """Evidence found in the judgment that holds it: a paragraph has the passage's start or middle, 70 characters, case and punctuation aside."""
    e = load(spark, sf, "evidence").filter("sentence is not null and citing_doc is not null").select("evidence_id", F.trim("citing_doc").alias("doc_id"), _plain(F.col("sentence")).alias("n")).distinct()
    # Bytes, as a letter says more in scripts with many; of a to z they are as many as letters.
    e = e.filter(F.octet_length("n") >= 24)
    half = F.floor(F.length("n") / 2).cast("int")
    low = F.greatest(half - 35, F.lit(0))
    e = e.select("evidence_id", "doc_id", F.substring("n", 1, 70).alias("start"), F.substring("n", low + 1, half + 35 - low).alias("middle"))
    # A line feed parts the paragraphs, and no probe holds one.
    texts = _texts(spark, sf).filter("text is not null").select("doc_id", F.array_join(F.transform(_paragraphs(F.col("text")), _plain), "\n").alias("body"))
    hit = e.join(texts, "doc_id").filter(F.contains("body", "start") | F.contains("body", "middle"))
    return hit.select("evidence_id", "doc_id").distinct()


def bench_from_judges(spark, sf):
    """The bench: the size given, else the judges listed, if more than one."""
    j = load(spark, sf, "judgments").filter("doc_id is not null").groupBy("doc_id").agg(F.max("bench_size").alias("b"), F.max(F.size("judges")).alias("n"))
    return j.select("doc_id", F.coalesce(F.nullif("b", F.lit(0)), F.when(F.col("n") > 1, F.col("n"))).alias("bench"))


QUERIES = {
    f.__name__: f
    for f in (catalog_dedup, title_search, criminal_titles, named_cases, fetch_plan, fetch_todo, corpus_status, corpus_skip_reasons, doc_meta_table, manifest, schema_violations, catalog_dates, titles_cased, party_sets, zones_cleaned, furniture_dropped, cite_keys, cite_key_resolve, page_range_resolve, resolve_cascade, resolve_full, mention_build, title_stopwords, name_jaccard_resolve, appeal_history, resolution_rollup, resolver_spot_check, data_checks, found_cites, found_mentions, citation_windows, evidence_located, bench_from_judges)
}


def _w(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _tok(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ({_w(tx.PARTY_STOP)})))"


def _side(x: str, i: int) -> str:
    cut = rf"regexp_replace({x}, '(?i)\s+(?:v/s|vs\.?|versus|v\.?)\s+', chr(1))"
    return f"nullif(split_part({cut}, chr(1), {i}), '')"


def _jac(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b}))::DOUBLE / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


def _iso(x: str) -> str:
    return f"strftime(try_strptime(trim({x}), '%d-%m-%Y'), '%Y-%m-%d')"


def _key_sql(x: str) -> str:
    ways = []
    for name, tail in (("SCR", ci._SCR), ("SCC", ci._SCC)):
        for pattern, s in ((rf"([0-9]{{4}})\s+Supp\.?\s*\(([0-9]{{1,2}})\)\s*{tail}", "S"), (rf"[\(\[]([0-9]{{4}})[\)\]]\s*([0-9]{{1,2}})\s*{tail}", ""), (rf"([0-9]{{4}})\s*\(([0-9]{{1,2}})\)\s*{tail}", "")):
            ways.append(f"CASE WHEN regexp_matches({x}, '{pattern}') THEN '{name}|' || regexp_extract({x}, '{pattern}', 1) || '|' || regexp_extract({x}, '{pattern}', 2)::INT || '|{s}|' || regexp_extract({x}, '{pattern}', 3)::INT END")
    air = r"A\.?I\.?R\.?\s*([0-9]{4})\s*S\.?C\.?\s*([0-9]{1,5})"
    ways.append(f"CASE WHEN regexp_matches({x}, '{air}') THEN 'AIR|' || regexp_extract({x}, '{air}', 1) || '|SC||' || regexp_extract({x}, '{air}', 2)::INT END")
    return f"coalesce({', '.join(ways)})"


_ENT = "en AS (SELECT * FROM entries WHERE path IS NOT NULL), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pdf_bytes IS NULL, pdf_bytes DESC, title) AS rn FROM en) WHERE rn = 1)"
_YRS = ", ".join(map(str, YEARS))
_CT = ca.CRIMINAL_TITLE
_CTX = ca.CRIMINAL_TEXT.replace(r"(?<!\w)", r"(?:^|\W)").replace(r"(?!\w)", r"(?:\W|$)")
_KEYS = f"ment AS (SELECT DISTINCT mention_id, cited_raw FROM resolutions), mk AS (SELECT mention_id, {_key_sql('cited_raw')} AS key FROM ment), keyed AS (SELECT * FROM mk WHERE key IS NOT NULL)"
_CK = f"jr AS (SELECT DISTINCT doc_id, unnest(reporter_citations) AS raw FROM judgments WHERE doc_id IS NOT NULL), ks AS (SELECT DISTINCT doc_id, {_key_sql('raw')} AS key FROM jr UNION SELECT DISTINCT doc_id, 'SCR|' || regexp_extract(doc_id, '{ci.PATH_ID}', 1) || '|' || regexp_extract(doc_id, '{ci.PATH_ID}', 2)::INT || '||' || regexp_extract(doc_id, '{ci.PATH_ID}', 3)::INT FROM judgments WHERE regexp_matches(doc_id, '{ci.PATH_ID}')), uk AS (SELECT key, min(doc_id) AS doc_id FROM ks WHERE key IS NOT NULL GROUP BY key HAVING count(*) = 1), bk AS (SELECT mention_id, min(doc_id) AS doc_id FROM keyed JOIN uk USING (key) GROUP BY mention_id)"
_PR = f"rg AS (SELECT DISTINCT regexp_extract(doc_id, '{ci.PATH_ID}', 1)::INT AS y, regexp_extract(doc_id, '{ci.PATH_ID}', 2)::INT AS v, regexp_extract(doc_id, '{ci.PATH_ID}', 3)::INT AS a, regexp_extract(doc_id, '{ci.PATH_ID}', 4)::INT AS b, doc_id FROM judgments WHERE regexp_matches(doc_id, '{ci.PATH_ID}')), ask AS (SELECT mention_id, split_part(key, '|', 2)::INT AS y, split_part(key, '|', 3)::INT AS v, split_part(key, '|', 5)::INT AS p FROM keyed WHERE regexp_matches(key, '^SCR\\|[0-9]+\\|[0-9]+\\|\\|')), rr AS (SELECT mention_id, doc_id, b, p, row_number() OVER (PARTITION BY mention_id ORDER BY a DESC, b DESC, doc_id DESC) AS rn FROM ask JOIN rg USING (y, v) WHERE a <= p), br AS (SELECT mention_id, doc_id FROM rr WHERE rn = 1 AND p <= b)"
_TT = "tt AS (SELECT doc_id, min(title) AS title, min(case_year) AS year FROM doc_meta WHERE doc_id IS NOT NULL AND title IS NOT NULL GROUP BY doc_id)"
_STOPS = f"{_TT}, tw AS (SELECT doc_id, unnest({_tok('title')}) AS token FROM tt), sw AS (SELECT token, count(*) AS df FROM tw GROUP BY token HAVING count(*) >= 5 AND count(*) > 0.02 * (SELECT count(*) FROM tt))"
_NM = "nm AS (SELECT DISTINCT span_id AS mention_id, citing_doc, name FROM name_spans WHERE name IS NOT NULL)"


def _private(x: str) -> str:
    pat = ci.OFFICE_SIDE
    return _tok("concat_ws(' ', " + ", ".join(f"CASE WHEN {_side(x, i)} IS NOT NULL AND NOT regexp_matches({_side(x, i)}, '{pat}') THEN {_side(x, i)} END" for i in (1, 2)) + ")")


ORACLE = {
    "catalog_dedup": f"WITH {_ENT} SELECT path, case_year, title, pdf_bytes FROM one",
    "title_search": f"SELECT DISTINCT path, title FROM entries WHERE path IS NOT NULL AND contains(lower(title), 'state') AND contains(lower(title), 'kesholi') AND case_year IN ({_YRS})",
    "criminal_titles": f"SELECT DISTINCT path, case_year FROM entries WHERE path IS NOT NULL AND case_year IN ({_YRS}) AND pdf_bytes IS NOT NULL AND regexp_matches(title, '{_CT}')",
    "named_cases": " UNION ".join(f"SELECT '{lab}' AS label, path FROM entries WHERE path IS NOT NULL AND pdf_bytes IS NOT NULL AND case_year IN ({', '.join(map(str, ys))}) AND regexp_matches(title, '{p}')" for lab, ys, p in NAMED),
    "fetch_plan": f"SELECT path, case_year FROM entries WHERE path IS NOT NULL AND case_year IN ({_YRS}) AND pdf_bytes IS NOT NULL AND regexp_matches(title, '{_CT}') UNION SELECT path, case_year FROM entries WHERE path IS NOT NULL AND pdf_bytes > 1000000",
    "fetch_todo": f"WITH {_ENT} SELECT path FROM one WHERE path NOT IN (SELECT regexp_replace(doc_id, '_EN$', '') FROM judgments WHERE doc_id IS NOT NULL)",
    "corpus_status": f"WITH {_ENT}, rd AS (SELECT DISTINCT regexp_replace(doc_id, '_EN$', '') AS path FROM judgments WHERE doc_id IS NOT NULL) SELECT case_year, count(*) AS entries, count(pdf_bytes) AS documents, count(*) FILTER (regexp_matches(title, '{_CT}')) AS criminal, count(rd.path) AS read FROM one LEFT JOIN rd USING (path) GROUP BY case_year ORDER BY case_year DESC LIMIT 30",
    "corpus_skip_reasons": f"WITH {_ENT}, tx AS (SELECT doc_id, min(text) AS text FROM judgments WHERE doc_id IS NOT NULL GROUP BY doc_id), r AS (SELECT CASE WHEN text IS NULL THEN 'no text' WHEN length(text) < 1500 THEN 'short' WHEN NOT regexp_matches(text, '{_CTX}') THEN 'not criminal' WHEN {_iso('decision_date')} IS NULL THEN 'bad record' ELSE 'kept' END AS reason FROM one LEFT JOIN tx ON tx.doc_id = path || '_EN') SELECT reason, count(*) AS n FROM r GROUP BY reason",
    "doc_meta_table": "WITH m AS (SELECT DISTINCT doc_id, title, case_year, bench FROM doc_meta WHERE doc_id IS NOT NULL), i AS (SELECT *, concat_ws(', ', case_year::VARCHAR, bench || '-judge bench') AS x FROM m) SELECT doc_id, coalesce(title, '') || CASE WHEN x <> '' THEN ' (' || x || ')' ELSE '' END AS label FROM i",
    "schema_violations": "WITH j AS (SELECT DISTINCT doc_id, decision_date, bench_size, len(judges) AS nj, map_keys(zones) AS z FROM judgments) SELECT DISTINCT doc_id, problem FROM (SELECT doc_id, 'no id' AS problem FROM j WHERE coalesce(trim(doc_id), '') = '' UNION ALL SELECT doc_id, 'date' FROM j WHERE decision_date IS NULL OR NOT regexp_matches(decision_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') OR try_cast(decision_date AS DATE) IS NULL UNION ALL SELECT doc_id, 'bench' FROM j WHERE bench_size < 1 UNION ALL SELECT doc_id, 'bench and judges' FROM j WHERE bench_size <> nj AND nj > 0 UNION ALL SELECT doc_id, 'zone' FROM j WHERE len(list_filter(z, lambda x: x NOT IN ('headnote', 'facts', 'arguments', 'holding'))) > 0)",
    "catalog_dates": rf"WITH e AS (SELECT DISTINCT path, decision_date, citation FROM entries WHERE path IS NOT NULL) SELECT path, {_iso('decision_date')} AS iso, nullif(regexp_extract(citation, '\b(1[89][0-9]{{2}}|20[0-9]{{2}})\b', 1), '')::INT AS year FROM e",
    "party_sets": f"WITH {_TT} SELECT doc_id, array_to_string(list_sort({_tok('title')}), ' ') AS tokens, round({_jac(_tok(_side('title', 1)), _tok(_side('title', 2)))}, 6) AS shared FROM tt",
    "cite_keys": f"WITH {_KEYS} SELECT mention_id, key FROM mk",
    "cite_key_resolve": f"WITH {_KEYS}, {_CK} SELECT * FROM bk",
    "page_range_resolve": f"WITH {_KEYS}, {_PR} SELECT * FROM br",
    "resolve_cascade": f"WITH {_KEYS}, {_CK}, {_PR} SELECT k.mention_id, coalesce(bk.doc_id, br.doc_id) AS doc_id, CASE WHEN bk.doc_id IS NOT NULL THEN 'cite' WHEN br.doc_id IS NOT NULL THEN 'scr_range' ELSE 'none' END AS method FROM (SELECT DISTINCT mention_id FROM keyed) k LEFT JOIN bk USING (mention_id) LEFT JOIN br USING (mention_id)",
    "resolve_full": f"""WITH {_CK.split(', bk AS')[0]}, {_PR.split(', ask AS')[0]}, {_STOPS}, st AS (SELECT list(token) AS s FROM sw),
      rk AS (SELECT mention_id, min({_key_sql('cited_raw')}) AS key FROM resolutions GROUP BY mention_id), nm AS (SELECT DISTINCT span_id AS mention_id, name FROM name_spans WHERE name IS NOT NULL),
      m AS (SELECT mention_id, key, coalesce(name, '') AS name, try_cast(split_part(key, '|', 2) AS INT) AS y FROM rk FULL JOIN nm USING (mention_id)),
      a AS (SELECT *, {_tok('name')} AS f FROM m), b AS (SELECT doc_id, year, {_tok('title')} AS f FROM tt),
      k AS (SELECT mention_id, any_value(uk.doc_id) AS doc_id FROM m JOIN uk USING (key) GROUP BY mention_id HAVING count(DISTINCT uk.doc_id) = 1),
      last AS (SELECT mention_id, max_by(rg.doc_id, (a, b, rg.doc_id)) AS doc_id, max((a, b, rg.doc_id)) AS best, any_value(split_part(key, '|', 5)::INT) AS p FROM m JOIN rg ON regexp_matches(key, '^SCR\\|[0-9]+\\|[0-9]+\\|\\|') AND m.y = rg.y AND split_part(key, '|', 3)::INT = rg.v AND rg.a <= split_part(key, '|', 5)::INT GROUP BY mention_id),
      r AS (SELECT l.mention_id, l.doc_id FROM last l JOIN rg USING (doc_id) JOIN a USING (mention_id) JOIN b ON b.doc_id = l.doc_id WHERE l.p <= rg.b AND {_jac('a.f', 'b.f')} >= 0.3 AND l.mention_id NOT IN (SELECT mention_id FROM m JOIN uk USING (key))),
      o AS (SELECT mention_id, y, f, list_filter(f, lambda x: NOT list_contains(s, x)) AS g, CASE WHEN y IS NULL THEN 0.75 ELSE 0.5 END AS need FROM a CROSS JOIN st WHERE mention_id NOT IN (SELECT mention_id FROM k) AND mention_id NOT IN (SELECT mention_id FROM r)),
      t AS (SELECT doc_id, year, f, list_filter(f, lambda x: NOT list_contains(s, x)) AS g FROM b CROSS JOIN st),
      sc AS (SELECT mention_id, doc_id, need, {_jac('o.f', 't.f')} AS score FROM o JOIN t ON list_has_any(o.g, t.g) AND (y IS NULL OR abs(y - year) <= 1) WHERE {_jac('o.g', 't.g')} >= need),
      w AS (SELECT *, row_number() OVER v AS rn, coalesce(lead(score) OVER v, 0) AS nx FROM sc WINDOW v AS (PARTITION BY mention_id ORDER BY score DESC, doc_id DESC)),
      n AS (SELECT mention_id, doc_id, score FROM w WHERE rn = 1 AND score >= need AND score - nx >= 0.1)
      SELECT m.mention_id, coalesce(k.doc_id, r.doc_id, n.doc_id) AS doc_id, CASE WHEN k.doc_id IS NOT NULL THEN 'cite' WHEN r.doc_id IS NOT NULL THEN 'scr_range' WHEN n.doc_id IS NOT NULL THEN 'name' ELSE 'none' END AS method,
        round(CASE WHEN k.doc_id IS NOT NULL OR r.doc_id IS NOT NULL THEN 1.0 ELSE coalesce(n.score, 0.0) END, 4)::DOUBLE AS score FROM m LEFT JOIN k USING (mention_id) LEFT JOIN r USING (mention_id) LEFT JOIN n USING (mention_id)""",
    "title_stopwords": f"WITH {_STOPS} SELECT * FROM sw",
    "name_jaccard_resolve": f"WITH {_STOPS}, {_NM}, st AS (SELECT list(token) AS s FROM sw), a AS (SELECT mention_id, {_tok('name')} AS f FROM nm), a2 AS (SELECT mention_id, f, list_filter(f, lambda x: NOT list_contains(s, x)) AS r FROM a CROSS JOIN st), b AS (SELECT doc_id, {_tok('title')} AS f FROM tt), b2 AS (SELECT doc_id, f, list_filter(f, lambda x: NOT list_contains(s, x)) AS r FROM b CROSS JOIN st), au AS (SELECT mention_id, unnest(r) AS token FROM a2), bu AS (SELECT doc_id, unnest(r) AS token FROM b2), pr AS (SELECT DISTINCT mention_id, doc_id FROM au JOIN bu USING (token)), sc AS (SELECT mention_id, doc_id, {_jac('a2.f', 'b2.f')} AS score FROM pr JOIN a2 USING (mention_id) JOIN b2 USING (doc_id) WHERE {_jac('a2.r', 'b2.r')} >= 0.75), k AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(score) OVER w, 0) AS nx FROM sc WINDOW w AS (PARTITION BY mention_id ORDER BY score DESC, doc_id DESC)) SELECT mention_id, doc_id, round(score, 4) AS score FROM k WHERE rn = 1 AND score >= 0.75 AND score - nx >= 0.1",
    "appeal_history": f"WITH {_TT}, {_NM}, x AS (SELECT mention_id, {_private('title')} AS p, {_private('name')} AS q, {_tok('name')} AS n FROM nm JOIN tt ON tt.doc_id = nm.citing_doc) SELECT mention_id, len(p) > 0 AND len(q) > 0 AND {_jac('p', 'q')} >= 0.6 AS same, len(p) > 0 AND len(list_filter(p, lambda z: NOT list_contains(n, z))) = 0 AS own FROM x",
    "resolution_rollup": "WITH r AS (SELECT DISTINCT mention_id, citing_doc, doc_id, method FROM resolutions) SELECT method, count(*) AS mentions, count(doc_id) AS resolved, count(DISTINCT CASE WHEN doc_id IS NOT NULL AND citing_doc IS NOT NULL THEN citing_doc || '>' || doc_id END) AS edges, grouping_id(method)::INT AS level FROM r GROUP BY ROLLUP (method)",
    "resolver_spot_check": f"WITH r AS (SELECT DISTINCT mention_id, cited_raw, doc_id, method FROM resolutions WHERE doc_id IS NOT NULL), k AS (SELECT *, {_key_sql('cited_raw')} AS key FROM r), jr AS (SELECT DISTINCT doc_id, unnest(reporter_citations) AS raw FROM judgments), o AS (SELECT doc_id, list({_key_sql('raw')}) AS keys FROM jr WHERE {_key_sql('raw')} IS NOT NULL GROUP BY doc_id) SELECT method, CASE WHEN key IS NULL OR keys IS NULL THEN 'unchecked' WHEN list_contains(keys, key) THEN 'match' ELSE 'mismatch' END AS state, count(*) AS n FROM k LEFT JOIN o USING (doc_id) GROUP BY ALL",
    "data_checks": f"WITH j AS (SELECT doc_id, max(bench_size) AS b, max(len(judges)) AS nj, max(len(reporter_citations)) AS nc FROM judgments WHERE doc_id IS NOT NULL GROUP BY doc_id) SELECT round(count(*) FILTER (coalesce(b > 0, false) OR coalesce(nj > 1, false)) / count(*), 6) AS bench_known, round(count(*) FILTER (nc > 0) / count(*), 6) AS reporter_key, round(count(*) FILTER (regexp_matches(doc_id, '{ci.PATH_ID}')) / count(*), 6) AS path_doc_id FROM j",
    "evidence_located": "WITH e AS (SELECT DISTINCT evidence_id, trim(citing_doc) AS doc_id, substr(sentence, 1, 70) AS probe FROM evidence WHERE sentence IS NOT NULL AND citing_doc IS NOT NULL), t AS (SELECT doc_id, min(text) AS text FROM judgments WHERE doc_id IS NOT NULL GROUP BY doc_id) SELECT evidence_id, doc_id FROM e JOIN t USING (doc_id) WHERE contains(text, probe)",
    "bench_from_judges": "SELECT doc_id, coalesce(nullif(max(bench_size), 0), CASE WHEN max(len(judges)) > 1 THEN max(len(judges)) END) AS bench FROM judgments WHERE doc_id IS NOT NULL GROUP BY doc_id",
}
