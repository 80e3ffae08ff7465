"""Errors instead of silent zeros, estimates, feasibility, digests, and labels that come again late."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexmill.operators import boolean, catalog, evaluation, feasibility, fusion, stored, treatment
from lexmill.sources import files
from lexmill.streaming import labels

SIGNALS = "qid string, doc_id string, rel double, cont double, health double, auth double"


def test_missing_signals_are_errors_if_asked(spark):
    df = spark.createDataFrame([("q", "a", 1.0, 0.5, 1.0, 0.1), ("q", "b", 2.0, None, 1.0, float("nan"))], SIGNALS)
    assert fusion.fused(df).count() == 2 * len(fusion.CONFIGS)
    with pytest.raises(PySparkException, match="no cont of b"):
        fusion.fused(df, strict=True).select("n_cont").collect()
    with pytest.raises(PySparkException, match="no auth of b"):
        fusion.fused(df, strict=True).select("n_auth").collect()


def test_missing_labels_are_errors_if_asked(spark):
    m = spark.createDataFrame([("x", True), ("y", False), ("z", True)], "key string, scope boolean")
    cache = spark.createDataFrame([("x", "followed", 0.9)], "key string, label string, confidence double")
    lax = {r["key"]: r["label"] for r in treatment.labelled(m, cache, "key", F.col("scope")).collect()}
    assert lax == {"x": "followed", "y": "neutral", "z": None}
    with pytest.raises(PySparkException, match="no label of z"):
        treatment.labelled(m, cache, "key", F.col("scope"), strict=True).collect()


def test_estimates_bound_and_order():
    df = {"a": 50, "b": 3, "c": 20}
    tree = boolean.parse("a AND (b OR c) AND NOT b AND b")
    assert stored.estimate(tree, df, 100) == 3 and stored.estimate(boolean.parse("a OR c OR a"), df, 100) == 100
    assert stored.estimate(boolean.parse('"a c"'), df, 100) == 20 and stored.estimate(boolean.parse("NOT a"), df, 100) == 100 and stored.estimate(boolean.parse("x /3 a"), df, 100) == 0
    assert [p for p in stored.planned(tree, df, 100).parts] == [boolean.Term("b"), boolean.Or((boolean.Term("b"), boolean.Term("c"))), boolean.Term("a"), boolean.Not(boolean.Term("b"))]


def test_feasibility(spark, tmp_path):
    rows = [(f"d{i}", "facts", f"murder weapon{'' if i % 2 else ' recovered under Sections 100, 302 and 34'} Section 3021") for i in range(8)] + [("e", "facts", None)]
    zones = spark.createDataFrame(rows, "doc_id string, zone string, text string")
    stored.write(zones, str(tmp_path))
    ix = stored.read(spark, str(tmp_path))
    asked = [("ok", "murders"), ("thin", "murder AND section 302"), ("empty", "murder 999"), ("bare", "302"), ("bad", "AND AND")]
    got = {r["qid"]: (r["candidates"], r["all_terms"], r["section"], r["documents"], r["verdict"]) for r in feasibility.feasibility(ix, zones, asked).collect()}
    assert got == {
        "ok": (8, 8, None, None, "ok"), "thin": (8, 8, "302", 4, "ok"), "empty": (8, 8, "999", 0, "empty"), "bare": (4, None, "302", 4, "ok"), "bad": (0, None, None, None, "empty"),
    }
    assert feasibility.content_terms("murder AND 302 of the murder weapon") == ["murder", "weapon"] and feasibility.section_numbers("Section 498A, 302") == ["498a", "302"]
    few = feasibility.feasibility(ix, zones.limit(3), [("few", "murder 302")]).first()
    assert few["verdict"] == "thin" and few["documents"] == 2


def test_equal_rows_do_not_cancel(spark, tmp_path):
    one = lambda rows: catalog.manifest(spark.createDataFrame(rows, "k string, v int"), "k", "v").first()["digest"]
    assert one([("a", 1), ("b", 2)]) == one([("b", 2), ("a", 1)])
    assert len({one([("a", 1)] * n) for n in range(1, 6)}) == 5
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_text("no table")
    assert files.append_only_new(df, str(tmp_path / "nothing"), "k").count() == 1
    with pytest.raises(Exception):  # noqa: B017
        files.append_only_new(df, str(tmp_path / "broken"), "k").count()


def test_labels_that_come_again_late_are_added_once(spark, tmp_path):
    src, sink, cp = (str(tmp_path / p) for p in ("in", "out", "cp"))
    schema = "key string, label string, labelled_at timestamp"
    (tmp_path / "in").mkdir()
    for i, day in enumerate(("2020-01-01", "2020-03-01", "2021-01-01")):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"key": k, "label": "followed", "labelled_at": f"{day}T00:00:00Z"}) for k in ("a", "a", f"only{i}")))
        labels.start_label_cache(labels.label_stream(spark, src, schema), sink, cp).awaitTermination(120)
    assert sorted(r["key"] for r in spark.read.parquet(sink).collect()) == ["a", "only0", "only1", "only2"]


def test_weightings_and_quotas():
    assert evaluation.simplex_grid(["a", "b"], 0.5, {"a": 0.5, "b": 1.0}) == []
    got = evaluation.simplex_grid(["a", "b", "c"], 0.25, {"b": 0.5})
    assert all(abs(sum(v.values()) - 1) < 1e-9 and v["b"] >= 0.5 for v in got) and len({tuple(v.items()) for v in got}) == len(got) == 6
    assert treatment.water_fill({"a": 5, "b": 1, "c": 9}, 8) == {"a": 4, "b": 1, "c": 3} and treatment.water_fill({}, 5) == {} and treatment.water_fill({"a": 2}, 0) == {"a": 0}
