"""Windows, sheets, loaders' refusals, determinism and scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import evaluation as ev
from lexmill.operators import fusion as fu
from lexmill.operators import treatment as tr
from lexmill.plans import law_queries, rank_eval_queries
from lexmill.session import load


def _spans(spark, sf):
    n = load(spark, sf, "name_spans").select("span_id", F.col("citing_doc").alias("doc_id"), "span_start", "span_end", "name").distinct()
    return n.join(law_queries._docs(spark, sf), "doc_id")


def marked_windows(spark, sf):
    """Name spans in a window of 200 characters on either side, marked."""
    lo, hi = F.greatest(F.col("span_start") - 200, F.lit(0)), F.least(F.col("span_end") + 200, F.length("text"))
    return _spans(spark, sf).select("span_id", tx.marked_window(F.col("text"), F.col("span_start"), F.col("span_end"), lo, hi).alias("window"))


def local_contexts(spark, sf):
    """The marked name with 20 characters on either side."""
    return marked_windows(spark, sf).select("span_id", tx.local_context(F.col("window"), 20).alias("context"))


def spans_hold_names(spark, sf):
    """Spans whose text is not the name they give (none)."""
    return _spans(spark, sf).filter(F.substring("text", F.col("span_start") + 1, F.col("span_end") - F.col("span_start")) != F.col("name")).select("span_id")


def cued_scope(spark, sf):
    """Evidence in the scope of labelling: not the judgment itself, with a cue in its sentence."""
    e = load(spark, sf, "evidence").select("evidence_id", "doc_id", "citing_doc", "sentence").distinct()
    cue = F.lower("sentence").rlike("overrul|doubt|per incuriam|not good law|distinguish|follow")
    return e.filter(F.coalesce((F.col("doc_id") != F.col("citing_doc")) & cue, F.lit(False))).select("evidence_id")


def content_words(spark, sf):
    """Telling words and section numbers of the evidence sentences."""
    e = load(spark, sf, "evidence").select("evidence_id", "sentence").distinct().filter("sentence is not null")
    return e.select("evidence_id", F.array_join(tx.section_numbers(F.col("sentence")), " ").alias("numbers"))


def body_offsets(spark, sf):
    """T21."""
    return law_queries._docs(spark, sf).filter("text is not null").select("doc_id", tx.body_offset(F.col("text")).alias("start"))


def gold_merge(spark, sf):
    """Two labelling sheets; the second doubts what has little confidence, the third settles the headnotes."""
    e = load(spark, sf, "evidence").select(F.col("evidence_id").alias("window_id"), "label", "confidence", "in_headnote").distinct()
    b = e.filter("window_id % 50 <> 0").withColumn("label", F.when(F.col("confidence") < 0.4, "neutral").otherwise(F.col("label")))
    return tr.merged_gold(e, b, e.filter("in_headnote"))


def both_treatments(spark, sf):
    """Judgments that are both followed and overruled."""
    return tr.both_sides(load(spark, sf, "evidence").filter("doc_id is not null"), "doc_id", "label", "followed", "overruled")


def qrels_conflicts(spark, sf):
    """Candidates of one query with different continuity."""
    rows = load(spark, sf, "signal_rows").select("qid", "doc_id", "rel").union(load(spark, sf, "hits").select("qid", "doc_id", "rel"))
    return ev.conflicting(rows.filter("rel is not null"), ["qid", "doc_id"], "rel")


def deterministic(spark, sf):
    """Rows on which two runs of the fused ranking differ (none)."""
    run = lambda parts: fu.ranked(fu.fused(rank_eval_queries._signals(spark, sf).repartition(parts)), 10).select("qid", "config", "doc_id", "rank")
    return ev.differences(run(3), run(7))


def scorecard(spark, sf):
    """Share of judged queries that reach P@10 of .3, per system."""
    m = rank_eval_queries._metrics(spark, sf).select(F.col("system").alias("lane"), F.lit(1.0).alias("weight"), (F.col("p10") >= 0.3).alias("passed"))
    return ev.scorecard(m)


QUERIES = {f.__name__: f for f in (marked_windows, local_contexts, spans_hold_names, cued_scope, content_words, body_offsets, gold_merge, both_treatments, qrels_conflicts, deterministic, scorecard)}

_SP = "sp AS (SELECT DISTINCT span_id, citing_doc AS doc_id, span_start AS s, span_end AS e, name FROM name_spans), dd AS (SELECT doc_id, min(text) AS text FROM judgments WHERE doc_id IS NOT NULL GROUP BY doc_id), x AS (SELECT span_id, s, e, name, text, greatest(s - 200, 0) AS lo, least(e + 200, length(text)) AS hi FROM sp JOIN dd USING (doc_id))"
ORACLE = {
    "marked_windows": f"WITH {_SP} SELECT span_id, substr(text, lo + 1, s - lo) || '[[' || substr(text, s + 1, e - s) || ']]' || substr(text, e + 1, hi - e) AS \"window\" FROM x",
    "local_contexts": f"WITH {_SP} SELECT span_id, substr(text, greatest(s - 20, 0) + 1, least(s, 20) + 1 - 1 + (e - s) + 20) AS context FROM x",
    "spans_hold_names": f"WITH {_SP} SELECT span_id FROM x WHERE substr(text, s + 1, e - s) <> name",
    "cued_scope": "SELECT DISTINCT evidence_id FROM evidence WHERE doc_id <> citing_doc AND regexp_matches(lower(sentence), 'overrul|doubt|per incuriam|not good law|distinguish|follow')",
    "gold_merge": "WITH e AS (SELECT DISTINCT evidence_id AS window_id, label, confidence, in_headnote FROM evidence), b AS (SELECT window_id, CASE WHEN confidence < 0.4 THEN 'neutral' ELSE label END AS label FROM e WHERE window_id % 50 <> 0) SELECT e.window_id, CASE WHEN e.label IS NULL OR b.label IS NULL THEN NULL WHEN e.label = b.label OR in_headnote THEN e.label END AS label, CASE WHEN e.label IS NULL OR b.label IS NULL THEN 'missing' WHEN e.label = b.label THEN 'agreed' WHEN in_headnote THEN 'adjudicated' ELSE 'unresolved' END AS state FROM e LEFT JOIN b USING (window_id)",
    "both_treatments": "SELECT doc_id FROM evidence WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING bool_or(label = 'followed') AND bool_or(label = 'overruled')",
    "qrels_conflicts": "WITH r AS (SELECT qid, doc_id, rel FROM signal_rows UNION ALL SELECT qid, doc_id, rel FROM hits) SELECT qid, doc_id, count(DISTINCT rel) AS \"values\" FROM r WHERE rel IS NOT NULL GROUP BY ALL HAVING count(DISTINCT rel) > 1",
    "deterministic": "SELECT qid, 'x' AS config, doc_id, 1 AS rank FROM signal_rows WHERE false",
    "scorecard": f"WITH {rank_eval_queries._M} SELECT system AS lane, round(avg((p10 >= 0.3)::INT), 6) AS share FROM m GROUP BY ROLLUP (system)",
}
