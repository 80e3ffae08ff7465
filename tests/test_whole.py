"""Whole results of registered queries on tables written for the purpose."""

import math

import pytest

from lexmill.plans import corpus_queries, law_queries, rank_eval_queries
from test_rank_eval import dense_pagerank


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_harmful_ranks_under_every_system(spark, tmp_path):
    hits = [("q1", "bad", "lnc_ltc", 3.0), ("q1", "ok", "phrase_hits", 9.0), ("q1", "bad", "phrase_hits", 8.0), ("q2", "bad", "phrase_hits", 1.0), ("q2", "ok", "new", 1.0), ("q3", "bad", None, 1.0), ("q3", "bad", "unscored", None)]
    hits += [("q4", f"d{i:02}", "lnc_ltc", 90.0 - i) for i in range(10)] + [("q4", "bad", "lnc_ltc", 1.0)]
    put(spark, tmp_path, "hits", hits, "qid string, doc_id string, system_name string, rel double")
    put(spark, tmp_path, "evidence", [("bad", "overruled"), ("ok", "followed"), (None, "overruled")], "doc_id string, label string")
    df = rank_eval_queries.harmful_rank_pivot(spark, str(tmp_path))
    assert set(df.columns) == {"qid", "doc_id", "lnc_ltc", "new", "null", "phrase_hits"}
    got = {(r["qid"], s): r[s] for r in df.collect() for s in df.columns[2:] if r[s] is not None}
    assert got == {("q1", "lnc_ltc"): 1, ("q1", "phrase_hits"): 2, ("q2", "phrase_hits"): 1, ("q3", "null"): 1}


def test_evidence_located_by_start_or_middle(spark, tmp_path):
    filler = "The lessor sealed the ledger in the presence of two clerks."
    long = "it is settled that a confession made to a police officer is not admissible against the accused person at all"
    text = f"{filler}\n\nHeld: it is settled that a Confession -- made to a\npolice officer -- is not admissible against the accused person, at all.\n\n \n{filler}\n\nThe widow left\n\nat noon with the surety."
    rows = [
        ("start", "a", "It is settled, that a [[confession]] made to a police officer is not admissible; but see below."),
        ("middle", " a ", f"garbled xx {long} yy garbled"),
        ("short", "a", "at noon with the"),
        ("across paragraphs", "a", "The widow left at noon with the surety."),
        ("elsewhere", "b", long),
        ("absent", "a", "Nothing of this kind was ever said by the court below."),
        ("none", "a", None),
        ("line of a long text", "c", "the nazir verified the roll of the court"),
        ("across lines of a long text", "c", "verified the roll of the court the nazir verified the roll"),
    ]
    put(spark, tmp_path, "evidence", rows, "evidence_id string, citing_doc string, sentence string")
    judgments = [("a", text, "t"), ("b", None, "t"), ("c", "The nazir verified the roll of the court\n" * 80, "t")]
    put(spark, tmp_path, "judgments", judgments, "doc_id string, text string, title string")
    got = sorted((r["evidence_id"], r["doc_id"]) for r in corpus_queries.evidence_located(spark, str(tmp_path)).collect())
    assert got == [("line of a long text", "c"), ("middle", "a"), ("start", "a")]


def test_authority_over_converged_pagerank(spark, tmp_path):
    edges = [("A", "B", 2.0), ("B", "C", 1.0), ("C", "D", 1.0), ("D", "E", 1.0), ("E", "F", 1.0), ("F", "A", 1.0), ("G", "A", 1.0), ("A", "G", 0.5), ("H", "F", 0.7)]
    put(spark, tmp_path, "resolutions", edges, "citing_doc string, doc_id string, score double")
    benches = {"A": 2, "C": 5, "F": 13, "H": 0}
    put(spark, tmp_path, "doc_meta", list(benches.items()), "doc_id string, bench int")
    pr = dense_pagerank(edges, "ABCDEFGH")
    raw = {d: math.log1p(len(pr) * p * min(1, math.log1p(benches.get(d) or 2) / math.log(8))) for d, p in pr.items()}
    want = {d: x / max(raw.values()) for d, x in raw.items()}
    got = {r["id"]: r["authority"] for r in law_queries.authority(spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-7)


def test_evidence_in_other_scripts_is_located(spark, tmp_path):
    hindi, tamil = "क्या ऐसी स्थिति में दोषसिद्धि टिक सकती है?", "இந்த நிலையில் தண்டனை நிலைக்குமா என்பது கேள்வி"
    put(spark, tmp_path, "evidence", [("verbatim", "a", hindi), ("punctuation", "a", tamil), ("other marks", "a", hindi.replace("ि", "ी")), ("elsewhere", "b", hindi), ("few letters", "a", "这样的定罪能够成立吗？")], "evidence_id string, citing_doc string, sentence string")
    text = f"The nazir sealed the roll.\n\nHeld: {hindi} No.\n\n{tamil.replace(' ', ', ', 1)}.这样的定罪能够成立吗"
    put(spark, tmp_path, "judgments", [("a", text, "t"), ("b", tamil, "t")], "doc_id string, text string, title string")
    got = sorted(r["evidence_id"] for r in corpus_queries.evidence_located(spark, str(tmp_path)).collect())
    assert got == ["few letters", "punctuation", "verbatim"]
