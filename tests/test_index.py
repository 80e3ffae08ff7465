"""Index, queries and scores on hand-computed cases."""

import math

import pytest

from lexmill.operators import boolean, index, scoring

DOCS = [("A", "holding", "alpha alpha beta"), ("B", "holding", "alpha gamma"), ("C", "holding", "gamma gamma gamma delta")]


@pytest.fixture(scope="module")
def corpus(spark):
    z = spark.createDataFrame(DOCS, "doc_id string, zone string, text string").cache()
    return index.positions(z).cache(), z


def scores(df, name="score"):
    return {r["doc_id"]: r[name] for r in df.collect()}


def test_cosine(corpus):
    s = scores(scoring.lnc_ltc(corpus[0], ["alpha", "alpha", "beta"]))
    assert s == pytest.approx({"A": 0.8925516, "B": 0.3060759}, abs=1e-6)


def test_norms(corpus):
    n = scores(index.doc_norms(corpus[0]), "norm")
    assert n == pytest.approx({"A": math.sqrt((1 + math.log10(2)) ** 2 + 1), "B": math.sqrt(2), "C": math.sqrt((1 + math.log10(3)) ** 2 + 1)})


def test_flat_bm25(corpus):
    s = scores(scoring.bm25_flat(*corpus, ["alpha"]))
    assert s == pytest.approx({"A": 0.6462550, "B": 0.5442147}, abs=1e-6)
    twice = scores(scoring.bm25_flat(*corpus, ["alpha", "alpha"]))
    assert twice["A"] == pytest.approx(2 * s["A"])


def test_top_k_ties(spark):
    s = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "doc_id string, score double")
    assert [r["doc_id"] for r in scoring.top_k(s, 2).collect()] == ["c", "a"]
    assert scoring.top_k(s, 0).count() == 0


def found(tree, corpus, how=boolean.evaluate):
    return sorted(r["doc_id"] for r in how(boolean.parse(tree), *corpus).collect())


@pytest.mark.parametrize(
    "query, want",
    [("alpha", "AB"), ("alpha AND gamma", "B"), ("alpha OR delta", "ABC"), ("NOT alpha", "C"), ("NOT NOT alpha", "AB"), ("gamma AND NOT delta", "B"), ('"alpha beta"', "A"), ('"beta alpha"', ""), ("alpha /1 gamma", "B"), ("(alpha OR delta) AND gamma", "BC")],
)
def test_boolean(corpus, query, want):
    assert "".join(found(query, corpus)) == want
    assert "".join(found(query, corpus, boolean.evaluate_one_by_one)) == want


@pytest.mark.parametrize("query", ["", "AND", "alpha AND", "(alpha", "alpha)", '""', "alpha beta", "/3 alpha", "alpha /3", "NOT", "(" * 200 + "a" + ")" * 200])
def test_malformed(query):
    with pytest.raises(ValueError):
        boolean.parse(query)


def test_fallback_is_a_bag_of_words(corpus):
    docs, terms = boolean.candidates("alpha delta AND", *corpus)
    assert sorted(r["doc_id"] for r in docs.collect()) == ["A", "B", "C"] and terms == ["alpha", "delta"]


def test_near_join_across_buckets(spark):
    rows = [("d", i) for i in range(40)]
    left, right = spark.createDataFrame(rows[:1], "doc_id string, pos int"), spark.createDataFrame(rows, "doc_id string, pos int")
    for reach in (0, 1, 5):
        assert boolean.near_docs(left, right.filter(f"pos = {reach}"), reach).count() == 1
        assert boolean.near_docs(left, right.filter(f"pos = {reach + 1}"), reach).count() == 0


def test_index_round_trip(spark, corpus, tmp_path):
    index.write_index(corpus[0], str(tmp_path / "ix"), 2)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "ix")).select("term", "doc_id", "tf").collect())) == sorted(map(tuple, index.postings(corpus[0]).select("term", "doc_id", "tf").collect()))
