"""Statutes, the citation graph and treatment over judgments, resolutions and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions.text import base_section, cache_key, normal_act, window_id
from lexmill.operators import evaluation as ev
from lexmill.operators import graph, statutes, treatment
from lexmill.session import load

PATTERN = r"Section ([0-9]+[A-Z]?)( IPC| Cr\.P\.C\.)?"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    j = load(spark, sf, "judgments").filter("doc_id is not null")
    return j.groupBy("doc_id").agg(F.min("decision_date").alias("date"), F.min("text").alias("text"))


def _mentions(spark, sf) -> DataFrame:
    """Sections in the order of the text by expressions alone: (doc_id, at, section, act)."""
    d = _docs(spark, sf).filter("text is not null")
    both = d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("at", "m"))
    act = F.nullif(F.regexp_extract("m", PATTERN, 2), F.lit(""))
    return both.select("doc_id", "at", F.regexp_extract("m", PATTERN, 1).alias("section"), normal_act(act, F.lit(None).cast("date")).alias("act"))


def statute_mentions(spark, sf):
    """Sections and codes per document."""
    return _mentions(spark, sf)


def act_asof(spark, sf):
    """The act of a bare section from the nearest mention of its family before it, else the first after it."""
    fam = statutes.section_families(statutes.statute_map(spark))
    rows = _mentions(spark, sf).join(F.broadcast(fam), "section", "left")
    past = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("doc_id").orderBy("at").rowsBetween(1, Window.unboundedFollowing)

    def of(acts):
        mine = F.when(F.col("act").isin(acts), F.col("act"))
        return F.coalesce(F.last(mine, ignorenulls=True).over(past), F.first(mine, ignorenulls=True).over(ahead))

    found = F.coalesce("act", F.when(F.col("family") == "substantive", of(statutes.SUBSTANTIVE)).when(F.col("family") == "procedural", of(statutes.PROCEDURAL)), F.lit("UNKNOWN"))
    return rows.select("doc_id", "at", "section", found.alias("act"))


def statute_refs(spark, sf):
    """U1-U5 with offsets, lists of sections and other acts left out: references per document."""
    m = statutes.statute_map(spark)
    return statutes.references(statutes.resolve_acts(statutes.mentions(_docs(spark, sf)), statutes.section_families(m)), statutes.provisions(m))


def section_counts(spark, sf):
    """U4: documents and mentions per section."""
    return _mentions(spark, sf).groupBy(base_section(F.col("section")).alias("section")).agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("doc_id").alias("documents"))


def map_pairs(spark, sf):
    """The mapping in both directions."""
    return statutes.map_pairs(statutes.statute_map(spark))


def continuity(spark, sf):
    """Queries for three provisions against the documents' references."""
    q = spark.createDataFrame([("q1", "BNS", "103"), ("q2", "IPC", "420"), ("q3", "BNSS", "482")], "qid string, act string, section string")
    refs = act_asof(spark, sf).select("doc_id", "act", "section").distinct()
    return statutes.continuity(q, refs, statutes.map_pairs(statutes.statute_map(spark)))


def feasibility(spark, sf):
    """Documents per section and a verdict."""
    n = _mentions(spark, sf).groupBy("section").agg(F.countDistinct("doc_id").alias("documents"))
    return n.withColumn("verdict", F.when(F.col("documents") >= 10, "ok").otherwise("thin"))


def audit_sample(spark, sf):
    """A seeded sample of mentions, at most two of a document."""
    m = _mentions(spark, sf).withColumn("h", F.sha2(F.concat_ws("|", F.lit("11"), "doc_id", F.col("at").cast("string")), 256))
    two = m.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("h"))).filter("rn <= 2")
    return two.orderBy("h").limit(40).select("doc_id", "at", "section")


def _edges(spark, sf) -> DataFrame:
    r = load(spark, sf, "resolutions").filter("doc_id is not null and citing_doc is not null")
    return r.select(F.trim("citing_doc").alias("src"), F.upper(F.trim("doc_id")).alias("dst"), F.when(F.col("score") == 0, 1.0).otherwise(F.col("score")).alias("w"))


def edge_dedup(spark, sf):
    """G7."""
    return graph.merged_edges(_edges(spark, sf)).select("src", "dst", F.round("w", 6).alias("w"))


def pagerank_4(spark, sf):
    """Four iterations."""
    return graph.pagerank(_edges(spark, sf), iterations=4).select("id", F.round("pr", 10).alias("pr"))


def pagerank(spark, sf):
    """To convergence, scaled to a largest of 1."""
    pr = graph.pagerank(_edges(spark, sf))
    top = pr.agg(F.max("pr").alias("top"))
    return pr.select("id", F.round(F.col("pr") / top.scalar(), 9).alias("pr"))


def _benches(spark, sf) -> DataFrame:
    return load(spark, sf, "doc_meta").filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("bench").alias("bench"))


def authority(spark, sf):
    """Over PageRank to convergence."""
    return graph.authority(graph.pagerank(_edges(spark, sf)), _benches(spark, sf)).select("id", F.round("authority", 8).alias("authority"))


def _citations(spark, sf) -> DataFrame:
    e = load(spark, sf, "evidence").select("evidence_id", "doc_id", "citing_doc", "label", "confidence", "citing_bench", "in_headnote").distinct()
    cited = _benches(spark, sf).select(F.col("id").alias("doc_id"), F.col("bench").alias("cited_bench"))
    rows = e.join(cited, "doc_id", "left")
    return rows.withColumn("valid", treatment.valid_negative(F.col("label"), F.col("citing_bench"), F.col("cited_bench")))


def citations(spark, sf):
    """Evidence with the validity of its negatives."""
    return _citations(spark, sf).select("evidence_id", "label", "citing_bench", "cited_bench", "valid")


def health_min(spark, sf):
    """G12."""
    return treatment.health(_citations(spark, sf), load(spark, sf, "doc_meta").filter("doc_id is not null"))


def evidence_top5(spark, sf):
    """G13."""
    return treatment.evidence_top(_citations(spark, sf))


def point_health(spark, sf):
    """Negatives that name no section, or one of the two asked for."""
    e = _citations(spark, sf).filter("valid").join(load(spark, sf, "evidence").select("evidence_id", "sentence").distinct(), "evidence_id")
    ids = F.array_distinct(F.regexp_extract_all("sentence", F.lit(r"(?:Section|s\.) ([0-9]+)"), F.lit(1)))
    return treatment.point_health(e.withColumn("offence_ids", F.coalesce(ids, F.array().cast("array<string>"))), F.array(F.lit("302"), F.lit("149")))


def label_join(spark, sf):
    """Labels by content key; windows out of scope are neutral."""
    e = load(spark, sf, "evidence").select("evidence_id", "citing_doc", "sentence", "label", "confidence", "in_headnote").distinct().withColumn("key", cache_key(F.lit("v1"), F.col("sentence")))
    cache = e.groupBy("key").agg(F.min("label").alias("label"), F.max("confidence").alias("confidence"))
    got = treatment.labelled(e.select("evidence_id", "key", "in_headnote"), cache, "key", ~F.col("in_headnote"))
    return got.select("evidence_id", "label", F.round("confidence", 6).alias("confidence"))


def window_ids(spark, sf):
    """Short ids of the name spans."""
    return load(spark, sf, "name_spans").select("span_id", window_id(F.col("citing_doc"), F.col("span_start"), F.col("span_end")).alias("window_id")).distinct()


def class_report(spark, sf):
    """A cue rule against the labels."""
    e = load(spark, sf, "evidence").select("evidence_id", "label", "sentence").distinct().filter("sentence is not null and label is not null")
    rule = F.when(F.lower("sentence").contains("overruled"), "overruled").when(F.lower("sentence").rlike("doubt"), "doubted").when(F.lower("sentence").rlike("follow|applied"), "followed").when(F.lower("sentence").contains("distinguish"), "distinguished").otherwise("neutral")
    r = ev.class_report(e.withColumn("pred", rule), "label", "pred")
    return r.select("label", "tp", "fp", "fn", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def few_shot(spark, sf):
    """The first three sentences of each label in sha1 order."""
    e = load(spark, sf, "evidence").filter("sentence is not null and label is not null").select("label", F.col("sentence").alias("window")).distinct()
    return treatment.few_shot_pool(e, 3).select("label", F.sha1("window").alias("window"))


def stratified_sample(spark, sf):
    """Thirty evidence rows over the labels."""
    e = load(spark, sf, "evidence").select(F.col("label").alias("bucket"), F.col("evidence_id").cast("string").alias("id")).distinct()
    return treatment.stratified_sample(e, 30, 5).select("bucket", "id")


def histograms(spark, sf):
    """Evidence by label and confidence band."""
    e = load(spark, sf, "evidence").select("evidence_id", "label", "confidence").distinct()
    band = F.when(F.col("confidence").isNull(), "none").when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "middle").otherwise("low")
    return e.groupBy("label", band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (statute_mentions, act_asof, statute_refs, section_counts, map_pairs, continuity, feasibility, audit_sample, edge_dedup, pagerank_4, pagerank, authority, citations, health_min, evidence_top5, point_health, label_join, window_ids, class_report, few_shot, stratified_sample, histograms)}

_D = "d AS (SELECT doc_id, min(text) AS text FROM judgments WHERE doc_id IS NOT NULL GROUP BY doc_id)"
_MEN = rf"{_D}, x AS (SELECT doc_id, regexp_extract_all(text, '{PATTERN}') AS m FROM d), y AS (SELECT doc_id, unnest(m) AS m, generate_subscripts(m, 1) - 1 AS at_ FROM x), men AS (SELECT doc_id, at_ AS at0, regexp_extract(m, '{PATTERN}', 1) AS section, CASE regexp_extract(m, '{PATTERN}', 2) WHEN ' IPC' THEN 'IPC' WHEN ' Cr.P.C.' THEN 'CRPC' END AS act FROM y)"
_MAP = "mp(oa, os, na, ns, note, weight) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}', '{n}', {0.5 if n == 'Sedition' else 1.0}::DOUBLE)" for a, b, c, d, n in statutes.PROVISIONS) + ")"
_FAM = f"{_MAP}, fm AS (SELECT section, CASE WHEN bool_or(p) AND bool_or(NOT p) THEN 'ambiguous' WHEN bool_or(p) THEN 'procedural' ELSE 'substantive' END AS family FROM (SELECT os AS section, oa = 'CRPC' AS p FROM mp UNION ALL SELECT ns, na = 'BNSS' FROM mp) GROUP BY section)"
_MINE = "coalesce(last_value(CASE WHEN act IN ({0}) THEN act END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY at0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(CASE WHEN act IN ({0}) THEN act END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY at0 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"
_MINE = _MINE.replace("END IGNORE NULLS)", "END IGNORE NULLS)")
_AS = f"{_MEN}, {_FAM}, ao AS (SELECT doc_id, at0, section, coalesce(act, CASE family WHEN 'substantive' THEN {_MINE.format(chr(39) + 'IPC' + chr(39) + ', ' + chr(39) + 'BNS' + chr(39))} WHEN 'procedural' THEN {_MINE.format(chr(39) + 'CRPC' + chr(39) + ', ' + chr(39) + 'BNSS' + chr(39))} END, 'UNKNOWN') AS act FROM men LEFT JOIN fm USING (section))"
_PAIRS = "pr AS (SELECT oa AS act_a, os AS section_a, na AS act_b, ns AS section_b, weight FROM mp UNION ALL SELECT na, ns, oa, os, weight FROM mp)"
_E = "e0 AS (SELECT trim(citing_doc) AS src, upper(trim(doc_id)) AS dst, CASE WHEN score = 0 THEN 1 ELSE score END AS w FROM resolutions WHERE doc_id IS NOT NULL AND citing_doc IS NOT NULL), e AS (SELECT src, dst, max(w) AS w FROM e0 WHERE src <> dst AND w > 0 GROUP BY ALL)"


def _rank_sql(n: int) -> str:
    sql = f"WITH {_E}, o AS (SELECT src, sum(w) AS t FROM e GROUP BY src), s AS (SELECT src, dst, w / t AS share FROM e JOIN o USING (src)), ids AS (SELECT src AS id FROM s UNION SELECT dst FROM s), n AS (SELECT count(*)::DOUBLE AS n FROM ids), p0 AS (SELECT id, 1 / n AS pr FROM ids CROSS JOIN n)"
    for i in range(1, n + 1):
        sql += f", g{i} AS (SELECT dst AS id, sum(pr * share) AS got FROM s JOIN p{i - 1} ON src = id GROUP BY dst), l{i} AS (SELECT coalesce(sum(pr), 0) AS loose FROM p{i - 1} WHERE id NOT IN (SELECT src FROM s)), p{i} AS (SELECT id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0) + loose / n) AS pr FROM ids LEFT JOIN g{i} USING (id) CROSS JOIN l{i} CROSS JOIN n)"
    return sql


_B = "bn AS (SELECT doc_id AS id, max(bench) AS bench FROM doc_meta WHERE doc_id IS NOT NULL GROUP BY doc_id)"
_C = f"{_B}, ev AS (SELECT DISTINCT evidence_id, doc_id, citing_doc, label, confidence, citing_bench, in_headnote FROM evidence), c AS (SELECT ev.*, bench AS cited_bench, coalesce(label IN ('overruled', 'doubted') AND citing_bench >= bench, false) AS valid FROM ev LEFT JOIN bn ON bn.id = ev.doc_id)"
_STR = "CASE label WHEN 'overruled' THEN 0.1::DOUBLE WHEN 'doubted' THEN 0.6::DOUBLE END"
_RULE = "CASE WHEN contains(lower(sentence), 'overruled') THEN 'overruled' WHEN contains(lower(sentence), 'doubt') THEN 'doubted' WHEN regexp_matches(lower(sentence), 'follow|applied') THEN 'followed' WHEN contains(lower(sentence), 'distinguish') THEN 'distinguished' ELSE 'neutral' END"
ORACLE = {
    "statute_mentions": f'WITH {_MEN} SELECT doc_id, at0 AS "at", section, act FROM men',
    "act_asof": f'WITH {_AS} SELECT doc_id, at0 AS "at", section, act FROM ao',
    "section_counts": f"WITH {_MEN} SELECT upper(section) AS section, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM men GROUP BY 1",
    "map_pairs": f"WITH {_MAP}, {_PAIRS} SELECT act_a, section_a, act_b, section_b, max(weight) AS weight FROM pr GROUP BY ALL",
    "continuity": f"WITH {_AS}, {_PAIRS}, q(qid, act_a, section_a) AS (VALUES ('q1', 'BNS', '103'), ('q2', 'IPC', '420'), ('q3', 'BNSS', '482')), w AS (SELECT qid, act_a, section_a, act_a AS act_b, section_a AS section_b, 1::DOUBLE AS weight FROM q UNION ALL SELECT qid, act_a, section_a, act_b, section_b, weight FROM q JOIN pr USING (act_a, section_a)), r AS (SELECT DISTINCT doc_id, act AS act_b, section AS section_b FROM ao), h AS (SELECT qid, doc_id, weight, act_a || ' ' || section_a || ' -> ' || act_b || ' ' || section_b AS why, row_number() OVER (PARTITION BY qid, doc_id ORDER BY weight DESC, act_a || ' ' || section_a || ' -> ' || act_b || ' ' || section_b) AS rn FROM w JOIN r USING (act_b, section_b)) SELECT qid, doc_id, weight, why FROM h WHERE rn = 1",
    "feasibility": f"WITH {_MEN} SELECT section, count(DISTINCT doc_id) AS documents, CASE WHEN count(DISTINCT doc_id) >= 10 THEN 'ok' ELSE 'thin' END AS verdict FROM men GROUP BY section",
    "audit_sample": f"WITH {_MEN}, k AS (SELECT *, sha256(concat_ws('|', '11', doc_id, at0::VARCHAR)) AS h FROM men), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY h) AS rn FROM k) SELECT doc_id, at0 AS \"at\", section FROM t WHERE rn <= 2 ORDER BY h LIMIT 40",
    "edge_dedup": f"WITH {_E} SELECT src, dst, round(w, 6) AS w FROM e",
    "pagerank_4": _rank_sql(4) + " SELECT id, round(pr, 10) AS pr FROM p4",
    "authority": _rank_sql(4) + f", {_B}, a AS (SELECT id, ln(1 + n * pr * least(1, ln(1 + coalesce(nullif(bench, 0), 2)) / ln(8))) AS a FROM p4 LEFT JOIN bn USING (id) CROSS JOIN n) SELECT id, round(a / max(a) OVER (), 8) AS authority FROM a",
    "citations": f"WITH {_C} SELECT evidence_id, label, citing_bench, cited_bench, valid FROM c",
    "health_min": f"WITH {_C}, h AS (SELECT doc_id, min({_STR}) AS h FROM c WHERE valid AND confidence >= 0.5 GROUP BY doc_id) SELECT bn.id AS doc_id, coalesce(h, 1) AS health FROM bn LEFT JOIN h ON h.doc_id = bn.id",
    "evidence_top5": f"WITH {_C}, u AS (SELECT *, coalesce(valid AND confidence >= 0.5, false) AS neg FROM c), k AS (SELECT doc_id, citing_doc, label, NOT neg AS g, CASE WHEN neg THEN {_STR} ELSE 0 END AS s, coalesce(in_headnote, false) AS h, CASE WHEN neg THEN 0 ELSE -coalesce(citing_bench, 0) END AS b, -coalesce(confidence, 0) AS cf FROM u WHERE neg OR label = 'followed'), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, citing_doc, label ORDER BY g, s, h, b, cf) AS one FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g, s, h, b, cf, citing_doc, label) AS place FROM o WHERE one = 1) SELECT doc_id, place, citing_doc, label FROM r WHERE place <= 5",
    "point_health": f"WITH {_C}, s AS (SELECT DISTINCT evidence_id, sentence FROM evidence), t AS (SELECT c.*, coalesce(regexp_extract_all(sentence, '(?:Section|s\\.) ([0-9]+)', 1), []) AS ids FROM c JOIN s USING (evidence_id) WHERE valid) SELECT doc_id, coalesce(min({_STR}) FILTER (len(ids) = 0 OR list_has_any(ids, ['302', '149'])), 1) AS health FROM t GROUP BY doc_id",
    "label_join": "WITH e AS (SELECT DISTINCT evidence_id, citing_doc, sentence, label, confidence, in_headnote, sha256(concat_ws(chr(31), 'v1', sentence)) AS k FROM evidence), c AS (SELECT k, min(label) AS label, max(confidence) AS confidence FROM e GROUP BY k) SELECT evidence_id, CASE WHEN NOT in_headnote THEN c.label ELSE 'neutral' END AS label, round(CASE WHEN NOT in_headnote THEN c.confidence ELSE 0 END, 6) AS confidence FROM e JOIN c USING (k)",
    "window_ids": "SELECT DISTINCT span_id, substr(sha1(concat_ws('|', citing_doc, span_start::VARCHAR, span_end::VARCHAR)), 1, 12) AS window_id FROM name_spans",
    "class_report": f"WITH e AS (SELECT DISTINCT evidence_id, label AS g, sentence FROM evidence WHERE sentence IS NOT NULL AND label IS NOT NULL), p AS (SELECT g, {_RULE} AS p FROM e), l AS (SELECT g AS label FROM p UNION SELECT p FROM p), t AS (SELECT label, (SELECT count(*) FROM p WHERE g = label AND p = label) AS tp, (SELECT count(*) FROM p WHERE g <> label AND p = label) AS fp, (SELECT count(*) FROM p WHERE g = label AND p <> label) AS fn FROM l) SELECT label, tp, fp, fn, tp + fn AS support, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM t",
    "few_shot": "WITH e AS (SELECT DISTINCT label, sentence FROM evidence WHERE sentence IS NOT NULL AND label IS NOT NULL), r AS (SELECT label, sha1(sentence) AS w, row_number() OVER (PARTITION BY label ORDER BY sha1(sentence), sentence) AS rn FROM e) SELECT label, w AS \"window\" FROM r WHERE rn <= 3",
    "histograms": "WITH e AS (SELECT DISTINCT evidence_id, label, confidence FROM evidence) SELECT label, CASE WHEN confidence IS NULL THEN 'none' WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'middle' ELSE 'low' END AS band, count(*) AS n FROM e GROUP BY ALL",
}
