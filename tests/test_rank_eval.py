"""Fusion, evaluation, graph and treatment on hand-computed cases."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import catalog, citations, evaluation, fusion, graph, statutes, treatment

ROWS = [("q", "A", 10.0, 1.0, 0.1, 0.5), ("q", "B", 9.5, 1.0, 1.0, 0.4), ("q", "C", 7.0, 0.0, 1.0, 0.9), ("q", "D", 6.0, 1.0, 1.0, 0.1)]
SIG = "qid string, doc_id string, rel double, cont double, health double, auth double"


def test_fusion(spark):
    r = fusion.fused(spark.createDataFrame(ROWS, SIG))
    got = {(x["config"], x["doc_id"]): x["final"] for x in r.collect()}
    want = {"full": (0.770, 0.875, 0.425, 0.400), "b1": (1.0, 0.9125, 0.175, 0.300), "b0": (1.0, 0.875, 0.250, 0.0)}
    for config, values in want.items():
        assert [got[config, d] for d in "ABCD"] == pytest.approx(values)
    order = [x["doc_id"] for x in fusion.ranked(r.filter("config = 'full'"), 10).orderBy("rank").collect()]
    assert order == ["B", "A", "C", "D"]


def test_fusion_edges(spark):
    rows = [("q", "A", 2.0, None, float("nan"), 0.0), ("q", "B", 2.0, 5.0, -1.0, 0.0)]
    n = {x["doc_id"]: x for x in fusion.normalised(spark.createDataFrame(rows, SIG)).collect()}
    assert (n["A"]["n_rel"], n["A"]["n_cont"], n["A"]["n_auth"], n["B"]["n_cont"], n["B"]["n_health"]) == (1.0, 0.0, 0.0, 1.0, 0.0)
    assert fusion.fused(spark.createDataFrame([], SIG)).count() == 0
    for bad in ({"nope": 1}, {"rel": -1}, {"cont": 1}, {"rel": 0}):
        with pytest.raises(ValueError):
            fusion.weights(bad)


def test_metrics(spark):
    runs = spark.createDataFrame([("s", "q", d, i + 1) for i, d in enumerate("abcde")], "system string, qid string, doc_id string, rn int")
    qrels = spark.createDataFrame([("q", "a", 2), ("q", "b", 0), ("q", "c", 1), ("q", "d", 0), ("q", "x", 2)], "qid string, doc_id string, grade int")
    m = evaluation.query_metrics(runs, qrels).first()
    assert (m["p5"], m["p10"], m["r10"]) == pytest.approx((0.4, 0.2, 2 / 3))
    assert m["ap"] == pytest.approx((1 + 2 / 3) / 3)
    import math

    assert m["ndcg10"] == pytest.approx(3.5 / (3 + 3 / math.log2(3) + 1 / math.log2(4)))
    none = evaluation.query_metrics(runs, qrels.withColumn("grade", F.lit(0))).first()
    assert none["ap"] is None and none["ndcg10"] is None and none["r10"] is None


def test_kappa(spark):
    p = spark.createDataFrame(list(zip([0, 0, 1, 1, 2, 2], [0, 0, 1, 2, 2, 2])), "a int, b int")
    k = evaluation.kappa(p, "a", "b").first()
    assert (k["agreement"], k["kappa"]) == pytest.approx((5 / 6, 0.75))
    assert evaluation.kappa(spark.createDataFrame([(1, 1)], "a int, b int"), "a", "b").first()["kappa"] == 1.0


def test_grid_and_sheets(spark):
    assert len(evaluation.simplex_grid(fusion.SIGNALS, 0.1, {"rel": 0.3})) == 120
    assert len(evaluation.simplex_grid(["rel", "cont"], 0.1, {})) == 11
    t = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c")], "qid string, doc_id string")
    f = spark.createDataFrame([("q", "a", 1), ("q", "a", 1), ("q", "b", None), ("q", "z", 0)], "qid string, doc_id string, grade int")
    assert {(r["doc_id"], r["problem"]) for r in evaluation.sheet_problems(f, t).collect()} == {("a", "repeated"), ("b", "blank"), ("c", "missing"), ("z", "extra")}


def dense_pagerank(edges, nodes, n_iter=300):
    best = {}
    for s, d, w in edges:
        if s != d and w > 0:
            best[s, d] = max(w, best.get((s, d), 0))
    out = {v: sum(w for (s, _), w in best.items() if s == v) for v in nodes}
    pr = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(n_iter):
        loose = sum(pr[v] for v in nodes if not out[v])
        new = dict.fromkeys(nodes, 0.15 / len(nodes) + 0.85 * loose / len(nodes))
        for (s, d), w in best.items():
            new[d] += 0.85 * pr[s] * w / out[s]
        pr = new
    return pr


def test_pagerank(spark):
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 1.0), ("a", "b", 1.0), ("c", "c", 5.0)]
    df = spark.createDataFrame(edges, "src string, dst string, w double")
    got = {r["id"]: r["pr"] for r in graph.pagerank(df).collect()}
    assert got == pytest.approx(dense_pagerank(edges, "abcd"), abs=1e-8)
    two = {r["id"]: r["pr"] for r in graph.pagerank(spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, w double")).collect()}
    assert two["a"] == pytest.approx(0.5 / 1.425, abs=1e-8)
    assert graph.pagerank(df.limit(0)).count() == 0


def test_bench_weight(spark):
    w = [r[0] for r in spark.createDataFrame([(7,), (13,), (None,), (2,), (0,)], "b int").select(graph.bench_weight(F.col("b"))).collect()]
    assert w[0] == w[1] == 1.0 and w[2] == w[3] == w[4]


def test_health(spark):
    rows = [("d1", "x", "overruled", 0.9, True, False, 5), ("d1", "y", "doubted", 0.9, True, False, 5), ("d2", "x", "overruled", 0.4, True, False, 5), ("d3", "x", "overruled", 0.9, False, False, 2)]
    c = spark.createDataFrame(rows, "doc_id string, citing_doc string, label string, confidence double, valid boolean, in_headnote boolean, citing_bench int")
    docs = spark.createDataFrame([(d,) for d in ("d1", "d2", "d3", "d4")], "doc_id string")
    assert {r["doc_id"]: r["health"] for r in treatment.health(c, docs).collect()} == {"d1": 0.1, "d2": 1.0, "d3": 1.0, "d4": 1.0}
    assert [(r["place"], r["label"]) for r in treatment.evidence_top(c.filter("doc_id = 'd1'")).orderBy("place").collect()] == [(1, "overruled"), (2, "doubted")]
    assert treatment.water_fill({"a": 2, "b": 50}, 10) == {"a": 2, "b": 8}


def test_statutes(spark):
    docs = spark.createDataFrame([("d1", "2019-05-01", "Section 302 was read with IPC 34. Section 438 of the Code, and Section 37 of the Narcotics Act."), ("d2", "2025-05-01", "Section 438 of the Code."), ("d3", None, None), ("d4", "", "")], "doc_id string, date string, text string")
    m = statutes.statute_map(spark)
    refs = statutes.references(statutes.resolve_acts(statutes.mentions(docs), statutes.section_families(m)), statutes.provisions(m))
    got = {(r["doc_id"], r["act"], r["section"]) for r in refs.collect()}
    assert got == {("d1", "IPC", "302"), ("d1", "IPC", "34"), ("d1", "CRPC", "438"), ("d2", "BNSS", "438")}
    assert statutes.parse_query("section 103", "2020-06-01")[0] == [("IPC", "103", None)]
    assert statutes.parse_query("section 103", "2025-02-01")[0] == [("BNS", "103", None)]
    assert statutes.parse_query("punishment for murder")[0] == [("UNKNOWN", "PROSE", "OFF_MURDER")]
    with pytest.raises(ValueError):
        statutes.parse_query("x", "01-02-2020")
    c = statutes.continuity(spark.createDataFrame([("q", "BNS", "103")], "qid string, act string, section string"), refs, statutes.map_pairs(m)).collect()
    assert [(r["doc_id"], r["weight"], r["why"]) for r in c] == [("d1", 1.0, "BNS 103 -> IPC 302")]


def test_page_range_is_an_asof_join(spark):
    rng = random.Random(1)
    ids = [f"2001_{v}_{a}_{a + rng.randrange(3, 30)}_EN" for v in (1, 2) for a in range(1, 200, 17)]
    j = spark.createDataFrame([(i, [f"[2001] {i.split('_')[1]} SCR {i.split('_')[2]}"]) for i in ids], "doc_id string, reporter_citations array<string>")
    ask = [(n, f"SCR|2001|{rng.choice([1, 2, 3])}||{rng.randrange(1, 230)}") for n in range(200)]
    got = {r["mention_id"]: r["doc_id"] for r in citations.by_range(spark.createDataFrame(ask, "mention_id long, key string"), citations.page_ranges(j)).collect()}
    for n, key in ask:
        _, _, v, _, p = key.split("|")
        spans = sorted((int(i.split("_")[2]), int(i.split("_")[3]), i) for i in ids if i.split("_")[1] == v)
        last = [s for s in spans if s[0] <= int(p)][-1:]
        assert got.get(n) == (last[0][2] if last and int(p) <= last[0][1] else None)


def test_catalog_guards(spark):
    with pytest.raises(ValueError):
        catalog.check_replacement(0, 0)
    with pytest.raises(ValueError):
        catalog.check_replacement(10, 21)
    catalog.check_replacement(11, 21)
