"""Index, Boolean search and scoring over the zones of the judgments."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.stem import stemmed
from lexmill.functions.text import LEGAL, LEGAL_NUMBER, STOP
from lexmill.operators import boolean, feasibility, index, scoring, stored
from lexmill.plans.sqltext import STEM_CTE, WEIGHT_CASE, ZONE_CTE, raw_tokens_of, words
from lexmill.session import load

#: The words and queries searched for.
WORDS = ["confession", "recovery", "murder", "302"]
FLAT_WORDS = ["confession", "confession", "recovery"]
PHRASE = ("dying", "declaration")


def _zones(spark: SparkSession, sf: str) -> DataFrame:
    return index.zone_texts(load(spark, sf, "judgments").select("doc_id", "zones"))


def _pos(spark: SparkSession, sf: str) -> DataFrame:
    return index.positions(_zones(spark, sf))


def _index(spark: SparkSession, sf: str, stems: bool = False) -> stored.Index:
    return stored.once(spark, sf, lambda: _zones(spark, sf), stems)


def tokenize(spark, sf):
    """Positions of tokens in each zone."""
    return _pos(spark, sf)


def postings(spark, sf):
    """Term frequency per document and zone, positions of all zones."""
    p = index.postings(_pos(spark, sf))
    return p.select("term", "doc_id", "tf", *[F.col(f"zone_tf.{z}").alias(f"tf_{z}") for z in index.ZONES], F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def vocab_df(spark, sf):
    """I4: document and collection frequency."""
    return index.vocabulary(_pos(spark, sf))


def top_terms(spark, sf):
    """I6."""
    return index.top_terms(_pos(spark, sf), 20)


def doc_norms(spark, sf):
    """I2."""
    return index.doc_norms(_pos(spark, sf)).select("doc_id", F.round("norm", 6).alias("norm"))


def zone_stats(spark, sf):
    """I3."""
    s = index.collection_stats(_zones(spark, sf))
    return s.select("docs", "tokens", *[F.round(c, 6).alias(c) for c in s.columns if c.startswith("avg")])


def postings_in_zone(spark, sf):
    """Documents with a term in a zone, with the positions of all zones."""
    p = index.postings(_pos(spark, sf)).filter((F.col("term") == "confession") & (F.col("zone_tf.holding") > 0))
    return p.select("doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def top_documents(spark, sf):
    """The documents with most occurrences of a term."""
    return index.postings(_pos(spark, sf)).filter(F.col("term") == "confession").orderBy(F.desc("tf"), "doc_id").limit(12).select("doc_id", "tf")


def token_fate(spark, sf):
    """What becomes of a text's raw tokens."""
    from lexmill.functions.text import STOP, TOKEN, is_legal, spelled

    raw = _zones(spark, sf).select(F.explode(F.regexp_extract_all(F.lower(spelled(F.col("text"))), F.lit(TOKEN), F.lit(0))).alias("t"))
    fate = F.when(is_legal(F.col("t")), "kept").when(F.col("t").isin(STOP), "stop word").otherwise("word")
    return raw.groupBy(fate.alias("fate")).agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("t").alias("distinct_tokens"))


def stemmed_vocab(spark, sf):
    """T4: document frequency of stems."""
    return index.vocabulary(stemmed(_pos(spark, sf)))


def _match(query: str, stems: bool = False):
    def run(spark, sf):
        ix = _index(spark, sf, stems)
        return boolean.evaluate(boolean.parse(query, stems), ix.positions, ix.norms)

    run.__doc__ = f"Documents that match: {query}"
    return run


def naive_differs(spark, sf):
    """Documents on which the two evaluators differ (none)."""
    tree = boolean.parse('(confession OR recovery) AND NOT (murder /3 charge) AND NOT "dying declaration"')
    pos, z = _pos(spark, sf), _zones(spark, sf)
    a, b = boolean.evaluate(tree, pos, z), boolean.evaluate_one_by_one(tree, pos, z)
    return a.exceptAll(b).union(b.exceptAll(a))


def phrase_per_zone(spark, sf):
    """A phrase inside one zone."""
    return boolean.phrase_starts(_pos(spark, sf), PHRASE, per_zone=True).select("doc_id", "zone").distinct()


def bow_fallback(spark, sf):
    """A query that cannot be parsed is a bag of words."""
    return boolean.candidates("confession recovery AND", _pos(spark, sf), _zones(spark, sf))[0]


def param_filter(spark, sf):
    """P5: documents by metadata, NULL asked for as NULL."""
    meta = load(spark, sf, "doc_meta").select("doc_id", "case_year", "bench").distinct()
    return boolean.filtered(meta, bench=None).unionByName(boolean.filtered(meta, bench=2, unknown=5))


def _bm25_zone(spark, sf, stems):
    ix = _index(spark, sf, stems)
    return stored.bm25_zone(ix, ix.words(" ".join(WORDS))).select("doc_id", *[F.round(c, 6).alias(c) for c in ("rel", *index.ZONES)])


def _score(way):
    def run(spark, sf, stems):
        ix = _index(spark, sf, stems)
        return way(ix, ix.words(" ".join(FLAT_WORDS))).select("doc_id", F.round("score", 6).alias("score"))

    return run


def _search_top(spark, sf, stems):
    return stored.search(_index(spark, sf, stems), "confession AND NOT murder", 10).select("doc_id", F.round("rel", 6).alias("rel"))


def _rank_cosine(spark, sf, stems):
    ix = _index(spark, sf, stems)
    docs, terms = stored.candidates(ix, "confession OR recovery")
    scored = docs.join(stored.lnc_ltc(ix, terms), "doc_id", "left")
    return scoring.top_k(scored.select("doc_id", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score")), 10)


def naive_matches(spark, sf):
    """What the plain set operations find, from left to right."""
    tree = boolean.parse('(confession OR recovery) AND NOT (murder /3 charge) AND NOT "dying declaration"')
    return boolean.evaluate_one_by_one(tree, _pos(spark, sf), _zones(spark, sf))


WORKED = ["confession AND recovery AND NOT murder", "confession OR recovery", '"dying declaration"', "NOT confession", "confession /3 evidence"]


def query_work(spark, sf):
    """The bound on a query's matches and what answering it reads."""
    return stored.work(_index(spark, sf), WORKED)


FEASIBLE = [("f1", "confession AND recovery section 302"), ("f2", "dying declaration"), ("f3", "unheardofword 9999"), ("f4", "section 498A 302")]


def query_feasibility(spark, sf):
    """Candidates, documents with every telling word and with each section, and a verdict, for stated queries."""
    texts = load(spark, sf, "judgments").filter("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    return feasibility.feasibility(_index(spark, sf), texts, FEASIBLE)


#: Searches over a stored index, of words as they stand and (``stem_...``) of stems.
SEARCHES = {
    "bm25_zone": (_bm25_zone, "K1, K2"),
    "bm25_flat": (_score(stored.bm25_flat), "K3"),
    "lnc_ltc": (_score(stored.lnc_ltc), "K4"),
    "okapi": (_score(stored.okapi), "K9"),
    "search_top": (_search_top, "K5, K6: the ten best of a parsed query; negated words score too"),
    "rank_cosine": (_rank_cosine, "K7: the same candidates under another scoring, unscored ones at 0"),
}


def _over(way, doc: str, stems: bool):
    def run(spark, sf):
        return way(spark, sf, stems)

    run.__doc__ = f"{doc}, over stems." if stems else f"{doc}."
    return run


def stem_tokens(spark, sf):
    """Positions of stems in each zone."""
    return _index(spark, sf, True).positions


def stem_lookup(spark, sf):
    """I4, I8: a query word finds the other forms of its stem: documents by stem of four queried words."""
    ix = _index(spark, sf, True)
    return ix.postings.filter(F.col("term").isin(ix.words("confessions recoveries murdered proceedings"))).groupBy("term").agg(F.countDistinct("doc_id").alias("df"), F.sum("tf").alias("cf"))


def spearman(spark, sf):
    """K8: agreement of two systems of ``hits`` per query."""
    h = load(spark, sf, "hits").select("qid", "doc_id", "system_name", "rel").filter("rel is not null").groupBy("qid", "doc_id", "system_name").agg(F.max("rel").alias("rel"))
    a, b = (h.filter(F.col("system_name") == s) for s in ("zone_bm25", "lnc_ltc"))
    return scoring.rank_agreement(a, b, "qid", "doc_id", "rel").select("qid", "n", F.round("spearman", 6).alias("spearman"))


def overlap_at_10(spark, sf):
    """K8: shared documents among two systems' ten best."""
    from pyspark.sql.window import Window

    h = load(spark, sf, "hits").filter("rel is not null").groupBy("qid", "doc_id", "system_name").agg(F.max("rel").alias("rel"))
    top = h.withColumn("rn", F.row_number().over(Window.partitionBy("qid", "system_name").orderBy(F.desc("rel"), "doc_id"))).filter("rn <= 10")
    a, b = (top.filter(F.col("system_name") == s).select("qid", "doc_id") for s in ("zone_bm25", "lnc_ltc"))
    return a.join(b, ["qid", "doc_id"]).groupBy("qid").agg((F.count(F.lit(1)) / 10.0).alias("overlap"))


BOOLEAN = {
    "term_match": "confession",
    "bool_and": "confession AND recovery",
    "bool_or": "confession OR murder",
    "bool_and_not": "confession AND NOT recovery",
    "bool_not": "NOT confession",
    "phrase": '"dying declaration"',
    "proximity_k": "confession /3 evidence",
    "proximity_s": "recovery /s evidence",
}
QUERIES = {
    f.__name__: f
    for f in (tokenize, postings, vocab_df, top_terms, doc_norms, zone_stats, postings_in_zone, top_documents, token_fate, stemmed_vocab, naive_differs, phrase_per_zone, bow_fallback, param_filter, spearman, overlap_at_10, stem_tokens, stem_lookup, naive_matches, query_work, query_feasibility)
} | {k: _match(q) for k, q in BOOLEAN.items()} | {f"stem_{k}": _match(q, True) for k, q in BOOLEAN.items()}
QUERIES |= {p + k: _over(way, doc, bool(p)) for p in ("", "stem_") for k, (way, doc) in SEARCHES.items()}


def _has(term: str) -> str:
    return f"SELECT DISTINCT doc_id FROM p WHERE term = '{term}'"


def _near(a: str, b: str, k: int) -> str:
    return f"SELECT DISTINCT l.doc_id FROM p l JOIN p r ON l.doc_id = r.doc_id AND abs(l.pos - r.pos) <= {k} WHERE l.term = '{a}' AND r.term = '{b}'"


def _bm25_zone_sql(terms: list[str]) -> str:
    return f"""
h AS (SELECT doc_id, zone, term, count(*) AS tf FROM p WHERE term IN ({words(terms)}) GROUP BY ALL),
dfs AS (SELECT term, count(DISTINCT doc_id) AS df FROM h GROUP BY term),
nn AS (SELECT count(DISTINCT doc_id) AS n FROM size),
az AS (SELECT zone, sum(len) AS total FROM size GROUP BY zone),
s AS (SELECT h.doc_id, h.zone, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / (total / n)))) AS s
      FROM h JOIN dfs USING (term) JOIN size USING (doc_id, zone) JOIN az USING (zone) CROSS JOIN nn),
zr AS (SELECT doc_id, sum(s * {WEIGHT_CASE}) AS rel, {', '.join(f"coalesce(sum(s) FILTER (zone = '{z}'), 0) AS {z}" for z in index.ZONES)} FROM s GROUP BY doc_id)"""


_TF = "tf0 AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL), ds AS (SELECT doc_id, sum(len) AS len FROM size GROUP BY doc_id), w AS (SELECT count(*) AS n, avg(len) AS av FROM ds)"
_Q = "q(term, qtf) AS (VALUES ('confession', 2), ('recovery', 1))"
_SAT = "(tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / av)))"


def _cosine(q: str) -> str:
    return f"""
{_TF}, {q}, h AS (SELECT doc_id, term, tf, qtf FROM tf0 JOIN q USING (term)), nd AS (SELECT count(DISTINCT doc_id) AS n FROM p),
wt AS (SELECT term, (1 + log10(any_value(qtf))) * log10(any_value(n)::DOUBLE / count(*)) AS wq FROM h CROSS JOIN nd GROUP BY term),
qn AS (SELECT sqrt(sum(wq * wq)) AS qnorm FROM wt),
dn AS (SELECT doc_id, sqrt(sum(pow(1 + log10(tf), 2))) AS norm FROM tf0 GROUP BY doc_id),
cs AS (SELECT doc_id, coalesce(sum((1 + log10(tf)) / norm * wq / nullif(qnorm, 0)), 0) AS score FROM h JOIN wt USING (term) JOIN dn USING (doc_id) CROSS JOIN qn GROUP BY doc_id)"""


_HITS = "h AS (SELECT qid, doc_id, system_name, max(rel) AS rel FROM hits WHERE rel IS NOT NULL GROUP BY ALL)"
_W = f"WITH {ZONE_CTE}"
_ALL = "SELECT DISTINCT doc_id FROM z"
ORACLE = {
    "tokenize": f"{_W} SELECT * FROM p",
    "postings": f"{_W} SELECT term, doc_id, count(*) AS tf, {', '.join(f"count(*) FILTER (zone = '{x}') AS tf_{x}" for x in index.ZONES)}, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM p GROUP BY ALL",
    "vocab_df": f"{_W} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY term",
    "top_terms": f"{_W} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY term ORDER BY df DESC, term LIMIT 20",
    "doc_norms": f"{_W}, t AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL) SELECT doc_id, round(sqrt(sum(pow(1 + log10(tf), 2))), 6) AS norm FROM t GROUP BY doc_id",
    "zone_stats": f"{_W}, n AS (SELECT count(DISTINCT doc_id) AS docs FROM size) SELECT any_value(docs) AS docs, sum(len)::BIGINT AS tokens, round(sum(len) / any_value(docs), 6) AS avg_len, {', '.join(f"round(coalesce(sum(len) FILTER (zone = '{x}'), 0) / any_value(docs), 6) AS avg_{x}" for x in index.ZONES)} FROM size CROSS JOIN n",
    "postings_in_zone": f"{_W} SELECT doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM p WHERE term = 'confession' GROUP BY doc_id HAVING count(*) FILTER (zone = 'holding') > 0",
    "top_documents": f"{_W} SELECT doc_id, count(*) AS tf FROM p WHERE term = 'confession' GROUP BY doc_id ORDER BY tf DESC, doc_id LIMIT 12",
    "naive_differs": f"{_W} SELECT doc_id FROM z WHERE false",
    "phrase_per_zone": f"{_W} SELECT DISTINCT a.doc_id, a.zone FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.zone = b.zone AND b.pos = a.pos + 1 WHERE a.term = 'dying' AND b.term = 'declaration'",
    "bow_fallback": f"{_W} SELECT DISTINCT doc_id FROM p WHERE term IN ('confession', 'recovery')",
    "param_filter": "SELECT DISTINCT doc_id, case_year, bench FROM doc_meta WHERE bench IS NULL OR bench = 2",
    "bm25_zone": f"{_W}, {_bm25_zone_sql(WORDS)} SELECT doc_id, round(rel, 6) AS rel, {', '.join(f'round({x}, 6) AS {x}' for x in index.ZONES)} FROM zr",
    "bm25_flat": f"{_W}, {_TF}, {_Q}, h AS (SELECT doc_id, term, tf, qtf FROM tf0 JOIN q USING (term)), d AS (SELECT term, count(*) AS df FROM h GROUP BY term) SELECT doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * {_SAT}), 6) AS score FROM h JOIN d USING (term) JOIN ds USING (doc_id) CROSS JOIN w GROUP BY doc_id",
    "lnc_ltc": f"{_W}, {_cosine(_Q)} SELECT doc_id, round(score, 6) AS score FROM cs",
    "okapi": f"{_W}, {_TF}, {_Q}, v AS (SELECT term, count(*) AS df FROM tf0 GROUP BY term), i AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM v CROSS JOIN w), m AS (SELECT avg(idf) AS mean FROM i), mi AS (SELECT term, CASE WHEN idf < 0 THEN mean * 0.25 ELSE idf END AS idf FROM i CROSS JOIN m) SELECT doc_id, round(sum(qtf * idf * {_SAT}), 6) AS score FROM tf0 JOIN q USING (term) JOIN mi USING (term) JOIN ds USING (doc_id) CROSS JOIN w GROUP BY doc_id",
    "search_top": f"{_W}, {_bm25_zone_sql(['confession', 'murder'])}, c AS ({_has('confession')} EXCEPT {_has('murder')}) SELECT doc_id, round(coalesce(rel, 0), 6) AS rel FROM c LEFT JOIN zr USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 10",
    "rank_cosine": f"{_W}, {_cosine("q(term, qtf) AS (VALUES ('confession', 1), ('recovery', 1))")}, c AS ({_has('confession')} UNION {_has('recovery')}) SELECT doc_id, round(coalesce(score, 0), 6) AS score FROM c LEFT JOIN cs USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 10",
    "spearman": f"WITH {_HITS}, b AS (SELECT a.qid, a.doc_id, a.rel AS x, c.rel AS y FROM h a JOIN h c USING (qid, doc_id) WHERE a.system_name = 'zone_bm25' AND c.system_name = 'lnc_ltc'), r AS (SELECT qid, rank() OVER (PARTITION BY qid ORDER BY x DESC) + (count(*) OVER (PARTITION BY qid, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY qid ORDER BY y DESC) + (count(*) OVER (PARTITION BY qid, y) - 1) / 2.0 AS ry FROM b) SELECT qid, count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY qid",
    "overlap_at_10": f"WITH {_HITS}, t AS (SELECT *, row_number() OVER (PARTITION BY qid, system_name ORDER BY rel DESC, doc_id) AS rn FROM h), k AS (SELECT * FROM t WHERE rn <= 10) SELECT a.qid, count(*) / 10.0 AS overlap FROM k a JOIN k b USING (qid, doc_id) WHERE a.system_name = 'zone_bm25' AND b.system_name = 'lnc_ltc' GROUP BY a.qid",
    "term_match": f"{_W} {_has('confession')}",
    "bool_and": f"{_W} {_has('confession')} INTERSECT {_has('recovery')}",
    "bool_or": f"{_W} {_has('confession')} UNION {_has('murder')}",
    "bool_and_not": f"{_W} {_has('confession')} EXCEPT {_has('recovery')}",
    "bool_not": f"{_W} {_ALL} EXCEPT {_has('confession')}",
    "phrase": f"{_W} SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'dying' AND b.term = 'declaration'",
    "proximity_k": f"{_W} {_near('confession', 'evidence', 3)}",
    "proximity_s": f"{_W} {_near('recovery', 'evidence', 5)}",
    "token_fate": f"{_W}, r AS (SELECT unnest({raw_tokens_of('text')}) AS t FROM z) SELECT CASE WHEN t IN ({words(LEGAL)}) OR regexp_matches(t, '{LEGAL_NUMBER}') THEN 'kept' WHEN t IN ({words(STOP)}) THEN 'stop word' ELSE 'word' END AS fate, count(*) AS tokens, count(DISTINCT t) AS distinct_tokens FROM r GROUP BY 1",
}


def _stemmed_sql(query: str, asked: list[str]) -> str:
    """A comparison query over stems: the same SQL with the stemmed positions, its words stemmed by SQL too."""
    query = query.replace(ZONE_CTE, STEM_CTE, 1)
    head, tail = query.split(STEM_CTE, 1)
    for w in sorted(asked, key=len, reverse=True):
        tail = re.sub(rf"(?<![\w'])'{w}'(?![\w'])", f"(SELECT stem FROM stems WHERE word = '{w}')", tail)
    return head + STEM_CTE + tail


_ASKED = ["confession", "recovery", "murder", "302", "dying", "declaration", "evidence"]
ORACLE |= {f"stem_{k}": _stemmed_sql(ORACLE[k], _ASKED) for k in [*BOOLEAN, *SEARCHES]}
ORACLE |= {
    "stem_tokens": f"WITH {STEM_CTE} SELECT doc_id, zone, term, pos FROM p",
    "stemmed_vocab": f"WITH {STEM_CTE} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY term",
    "stem_lookup": f"WITH {STEM_CTE} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p WHERE term IN (SELECT stem FROM stems WHERE word IN ('confessions', 'recoveries', 'murdered', 'proceedings')) GROUP BY term",
}


def _df(*terms: str) -> str:
    return f"(SELECT count(DISTINCT doc_id) FROM p WHERE term = '{terms[0]}')" if len(terms) == 1 else f"least({', '.join(_df(t) for t in terms)})"


def _work(query: str, estimate: str, terms: list[str]) -> str:
    return f"SELECT '{query}' AS query, {estimate} AS estimate, (SELECT count(*) FROM (SELECT DISTINCT doc_id, term FROM p WHERE term IN ({words(terms)}))) AS postings, (SELECT count(*) FROM p WHERE term IN ({words(terms)})) AS positions"


def _feasible(qid: str, matched: str, every: list[str] | None, sections: list[str]) -> str:
    both = " INTERSECT ".join(_has(w) for w in every) if every else ""
    all_terms = f"(SELECT count(*) FROM ({both}))" if every else "NULL::BIGINT"
    lead, more = feasibility._LEAD, feasibility._MORE
    named = lambda n: f"(SELECT count(*) FROM jt WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9]){lead}{more}{n}([^A-Za-z0-9]|$)'))"
    rows = [(f"'{n}'", named(n)) for n in sections] or [("NULL::VARCHAR", "NULL::BIGINT")]
    return " UNION ALL ".join(f"SELECT '{qid}' AS qid, (SELECT count(*) FROM ({matched})) AS candidates, {all_terms} AS all_terms, {n} AS section, {c} AS documents" for n, c in rows)


_DOCS = "(SELECT count(DISTINCT doc_id) FROM z)"
_BAG = lambda *terms: f"SELECT DISTINCT doc_id FROM p WHERE term IN ({words(terms)})"
ORACLE |= {
    "naive_matches": f"{_W} ({_has('confession')} UNION {_has('recovery')}) EXCEPT ({_near('murder', 'charge', 3)}) EXCEPT ({ORACLE['phrase'].split(ZONE_CTE, 1)[1]})",
    "query_work": f"{_W} " + " UNION ALL ".join([
        _work(WORKED[0], _df("confession", "recovery"), ["confession", "recovery", "murder"]), _work(WORKED[1], f"least({_DOCS}, {_df('confession')} + {_df('recovery')})", ["confession", "recovery"]),
        _work(WORKED[2], _df("dying", "declaration"), ["dying", "declaration"]), _work(WORKED[3], _DOCS, ["confession"]), _work(WORKED[4], _df("confession", "evidence"), ["confession", "evidence"]),
    ]),
    "query_feasibility": f"{_W}, jt AS (SELECT doc_id, min(text) AS text FROM judgments WHERE doc_id IS NOT NULL GROUP BY doc_id), f AS ("
    + " UNION ALL ".join([
        _feasible("f1", _BAG("confession", "recovery", "section", "302"), ["confession", "recovery", "section"], ["302"]), _feasible("f2", _BAG("dying", "declaration"), ["dying", "declaration"], []),
        _feasible("f3", _BAG("unheardofword", "9999"), ["unheardofword"], ["9999"]), _feasible("f4", _BAG("section", "498a", "302"), ["section"], ["498a", "302"]),
    ])
    + ") SELECT *, CASE WHEN min(least(candidates, all_terms, documents)) OVER (PARTITION BY qid) = 0 THEN 'empty' WHEN min(least(all_terms, documents)) OVER (PARTITION BY qid) <= 3 THEN 'thin' ELSE 'ok' END AS verdict FROM f",
}
