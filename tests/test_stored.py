"""The stored index against the searches over texts, stemmed queries, and what a query reads."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions.stem import stem_token
from lexmill.operators import boolean, index, scoring, stored

TEXTS = [
    ("a", "headnote", "Confession of murder. Confessions recovered under Section 302 IPC."), ("a", "holding", "The confession was recovered."), ("b", "facts", "A recovery of weapons; the murdered man confessed."),
    ("c", "facts", ""), ("d", "arguments", None), ("e", "holding", "murder murder murder " * 50),
]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    zones = spark.createDataFrame(TEXTS, "doc_id string, zone string, text string")
    out = {}
    for stems in (False, True):
        path = str(tmp_path_factory.mktemp("index"))
        stored.write(zones, path, stems)
        out[stems] = stored.read(spark, path, stems)
    return zones, out


def rows(df):
    return {r[0]: tuple(round(x, 9) for x in r[1:]) for r in df.collect()}


@pytest.mark.parametrize("words", [["murder", "302"], ["confession", "confession", "recovery"], ["absent"], []])
def test_scores_are_those_over_texts(built, words):
    zones, ix = built[0], built[1][False]
    pos = index.positions(zones)
    assert rows(stored.bm25_zone(ix, words)) == rows(scoring.bm25_zone(pos, zones, words))
    assert rows(stored.bm25_flat(ix, words)) == rows(scoring.bm25_flat(pos, zones, words))
    assert rows(stored.okapi(ix, words)) == rows(scoring.okapi(pos, zones, words))
    assert rows(stored.lnc_ltc(ix, words)) == rows(scoring.lnc_ltc(pos, words))


def test_words_find_the_other_forms_of_their_stem(built):
    ix = built[1][True]
    found = lambda q: {r["doc_id"] for r in stored.candidates(ix, q)[0].collect()}
    assert found("confessions") == found("confess") | {"a"} and found("recoveries") == {"b"} and found("recover") == {"a"}
    assert found('"murdered man"') == {"b"} and found("murdered AND 302") == {"a"} and found("NOT murder") == {"c", "d"}
    assert stem_token("302") == "302" and stem_token("ipc") == "ipc" and stem_token("confessions") == "confess"


def test_a_query_reads_its_terms_alone(built):
    plan = stored.bm25_zone(built[1][True], ["murder"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,murder)" in plan or "In(term, [murder])" in plan
    assert "positions" not in plan
    tree = boolean.evaluate(boolean.parse("murder AND NOT confession", True), built[1][True].positions, built[1][True].norms)
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,murder)" in tree._jdf.queryExecution().executedPlan().toString()


def test_an_index_is_built_once(spark):
    calls = []

    def zones():
        calls.append(1)
        return spark.createDataFrame(TEXTS, "doc_id string, zone string, text string")

    for _ in range(2):
        assert stored.once(spark, "small", zones).vocabulary.filter(F.col("term") == "murder").count() == 1
    assert len(calls) == 1
    empty = stored.once(spark, "none", lambda: spark.createDataFrame([], "doc_id string, zone string, text string"))
    assert stored.search(empty, "murder", 5).count() == 0
