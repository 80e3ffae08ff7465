"""Windows, sheets, labelling by an injected function, year lists, the whole ranking on a small corpus."""

import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import evaluation, ranking, treatment
from lexmill.operators.ranking import Corpus


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_windows(spark):
    w = one(spark, tx.marked_window(F.lit("before NAME after"), F.lit(7), F.lit(11), F.lit(0), F.lit(17)))
    assert w == "before [[NAME]] after"
    assert one(spark, tx.local_context(F.lit(w), 3)) == "re NAME af"
    assert one(spark, tx.local_context(F.lit("no mark"))) is None
    assert one(spark, tx.body_offset(F.lit("x CRIMINAL APPELLATE JURISDICTION"))) == 2 and one(spark, tx.body_offset(F.lit("x"))) == 0


def test_years():
    assert tx.years("2025-2023,2012") == [2025, 2024, 2023, 2012] and tx.years("") == []


def test_injected_labeller(spark):
    def call(texts):
        return [json.dumps({"label": "followed", "confidence": 0.9}) if "follow" in t else "not json" for t in texts]

    w = spark.createDataFrame([("a", "we follow"), ("b", "else"), ("a", "we follow")], "key string, window string")
    assert {(r["key"], r["label"], r["confidence"]) for r in treatment.batch_labels(w, call, 1).collect()} == {("a", "followed", 0.9), ("b", None, None)}


def test_gold(spark):
    s = "window_id string, label string"
    a, b = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "x"), ("4", "x")], s), spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "y")], s)
    got = {(r["window_id"], r["label"], r["state"]) for r in treatment.merged_gold(a, b, spark.createDataFrame([("2", "y")], s)).collect()}
    assert got == {("1", "x", "agreed"), ("2", "y", "adjudicated"), ("3", None, "unresolved"), ("4", None, "missing")}


def test_reports(spark):
    rows = spark.createDataFrame([("s", "gold", "gold"), ("s", "gold", "neutral"), ("s", "neutral", "gold")], "s string, g string, p string")
    r = {x["label"]: (x["tp"], x["fp"], x["fn"]) for x in evaluation.class_report(rows, "g", "p").collect()}
    assert r == {"gold": (1, 1, 1), "neutral": (0, 1, 1)}
    lanes = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, False), ("b", 1.0, True)], "lane string, weight double, passed boolean")
    assert {(x["lane"], x["share"]) for x in evaluation.scorecard(lanes).collect()} == {("a", 0.25), ("b", 1.0), (None, 0.4)}


def test_bootstrap(spark):
    rows = spark.createDataFrame([("p", f"q{i}", 0.5, 0.5 + (0.1 if i < 5 else -0.1 * (i == 9))) for i in range(10)], "pair string, qid string, a double, b double")
    r = evaluation.bootstrap(rows, "a", "b", n_boot=500, seed=1).first()
    assert r["n"] == 10 and r["diff"] == pytest.approx(0.04) and r["low"] <= r["diff"] <= r["high"]
    assert evaluation.bootstrap(rows.withColumn("a", F.lit(None).cast("double")), "a", "b", n_boot=5).first()["n"] == 0


def test_whole_ranking(spark):
    zones = spark.createDataFrame([("d1", "holding", "confession under Section 302 IPC"), ("d2", "facts", "confession recorded"), ("d3", "facts", "nothing")], "doc_id string, zone string, text string")
    texts = spark.createDataFrame([("d1", "2019-01-01", "confession under Section 302 IPC"), ("d2", "2019-01-01", "confession recorded"), ("d3", None, None)], "doc_id string, date string, text string")
    cites = spark.createDataFrame([("d1", "x", "overruled", 0.9, True, False, 5)], "doc_id string, citing_doc string, label string, confidence double, valid boolean, in_headnote boolean, citing_bench int")
    auth = spark.createDataFrame([("d1", 1.0)], "id string, authority double")
    corpus = Corpus(zones, texts, cites, auth)
    got = {r["doc_id"]: r for r in ranking.signals(corpus, "confession OR section", "2025-01-01").collect()}
    assert set(got) == {"d1", "d2"} and got["d1"]["health"] == 0.1 and got["d2"]["auth"] == 0.0
    bns = ranking.signals(corpus, "Section 103 BNS confession", "2025-01-01").filter("doc_id = 'd1'").first()
    assert bns["cont"] == 1.0 and "BNS 103 -> IPC 302" in bns["cont_why"]
    assert [r["rank"] for r in ranking.rank(corpus, "confession").orderBy("rank").collect()] == [1, 2]
    with pytest.raises(ValueError):
        ranking.signals(corpus, "  ")


def test_classifier_on_held_out_windows(spark):
    from lexmill.operators import classifier

    cues = {"followed": "that decision was followed and applied", "overruled": "the earlier view stands overruled", "doubted": "we have some doubt about that view"}
    fillers = ["the lessor sealed the ledger", "the surety read the cheque", "bail was granted on a bond", "the widow left at noon", "the nazir verified the roll", "counsel was heard at length"]
    rows = [(f"{f}; {c}, {g}", label, i % 3) for label, c in cues.items() for i, (f, g) in enumerate((f, g) for f in fillers for g in fillers)]
    df = spark.createDataFrame(rows + [(None, "followed", 1), ("x", None, 1)], "window string, label string, fold int")
    held = classifier.predict(classifier.fit(df.filter("fold > 0")), df.filter("fold = 0")).select("label", "pred", "probability").collect()
    assert sum(r["label"] == r["pred"] for r in held) / len(held) > 0.95 and all(0 <= r["probability"] <= 1 for r in held)


def test_cleaning(spark):
    page = "SUPREME COURT REPORTS\nThe learned coun-\nsel   spoke.\nA\n303\n[1959] 2 S.C.R. 303\nEnd."
    assert one(spark, tx.without_furniture(F.lit(page))) == "The learned coun-sel spoke. End."
    assert one(spark, tx.clean_zone(F.lit("a  b\r\n\r\n\r\n\r\nc "))) == "a b\n\nc"
    assert one(spark, tx.without_controls(F.lit("a\fb­c\u0001"))) == "a\nbc"
    assert one(spark, tx.section_numbers(F.lit("sections 302, 120 and 302 of the Act of 1860"))) == ["302", "120", "1860"]
    assert one(spark, tx.content_terms(F.lit("the murder of the murder witness 302"))) == ["murder", "witness"]
    assert one(spark, tx.excerpt(F.lit("one  two three"), 9)) == "one tw..."
    assert one(spark, tx.doc_label(F.lit("X v. Y"), F.lit(None).cast("string"), F.lit(3))) == "X v. Y (3-judge bench)"
