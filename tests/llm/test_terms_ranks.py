"""Term counting and rank fusion against brute force, and their edge cases."""

import random
import statistics
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import ranks, terms

WORDS = st.text(alphabet="abcäक़1", min_size=1, max_size=9)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(WORDS, st.tuples(st.integers(1, 10**6), st.integers(1, 10**4)), max_size=60))
def test_container_round_trip(leaf):
    assert {s: (a, b) for s, a, b in terms.unpack(terms.pack(leaf))} == leaf


@settings(max_examples=40, deadline=None)
@given(st.lists(WORDS, max_size=300))
def test_burst_trie_counts(words):
    trie = terms.BurstTrie(burst=4)
    for w in words:
        trie.add(w, 1, 1)
    assert {p + s: c[0] for p, leaf in trie.containers() for s, c in leaf.items()} == Counter(words)


def brute_terms(rows):
    occ, docs = Counter(), defaultdict(set)
    for d, t in {(d, t) for d, t, *_ in rows if d is not None and t}:
        for w in terms.TERM.findall(t.lower()):
            occ[w] += 1
            docs[w].add(d)
    return {w: (n, len(docs[w])) for w, n in occ.items()}


SCHEMA = "doc_id string, text string, field string, record string, value string"


@pytest.mark.parametrize("route_terms", [20_000, 5])
def test_terms_against_brute_force(spark, route_terms):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abन") for _ in range(rng.randrange(1, 8))) for _ in range(300)] + ["a" * 40, "a" * 41]
    rows = [(f"d{i}", " ".join(rng.choices(vocabulary, k=40)), "x", "y", None) for i in range(60)]
    rows += rows[:9] + [("e", None, None, None, None), ("f", "", None, None, None), (None, "lost", None, None, None), ("g", "İ’m  ok-ok", None, None, None), ("h", "long " * 50_000, None, None, None)]
    got = terms.term_counts(spark.createDataFrame(rows, SCHEMA).repartition(5), "doc_id", {"text": "text"}, route_terms)
    assert {r["term"]: (r["occurrences"], r["records"]) for r in got.collect()} == brute_terms(rows)


def test_terms_of_nothing_and_bands(spark):
    assert terms.term_counts(spark.createDataFrame([], SCHEMA), "doc_id", {"text": "text"}).count() == 0
    c = spark.createDataFrame([("text", "a", 9, 2), ("text", "b", 9, 3), ("text", "c", 9, 4)], "field string, term string, occurrences long, records long")
    assert {r["term"]: r["band"] for r in terms.banded(c, {"text": 10}).collect()} == {"a": "rare", "b": None, "c": "common"}


def brute_order(rows, names):
    best, items = {}, defaultdict(set)
    for g, i, s, v in rows:
        if g is None or i is None:
            continue
        items[g].add(i)
        if s in names and v is not None and v == v:
            best[g, s, i] = max(v, best.get((g, s, i), v))
    out = {}
    for g, members in items.items():
        table = {}
        for i in members:
            mine = []
            for s in names:
                scored = [v for (h, t, _), v in best.items() if (h, t) == (g, s)]
                v = best.get((g, s, i))
                mine.append((len(members) + len(scored) + 1) / 2 if v is None else sum(x > v for x in scored) + (scored.count(v) + 1) / 2)
            table[i] = (statistics.median(mine), statistics.fmean(mine))
        for place, i in enumerate(sorted(members, key=lambda i: (*table[i], i)), 1):
            out[g, i] = (*table[i], place)
    return out


ROW = "q string, d string, s string, v double, g string, i string, r double, slice int"


@pytest.mark.parametrize("slice_rows", [100_000, 5])
def test_order_against_brute_force(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(ranks, "SLICE_ROWS", slice_rows)
    rng = random.Random(4)
    rows = [(f"q{rng.randrange(3)}", f"d{rng.randrange(30)}", s, rng.choice([0.0, 1.0, round(rng.gauss(0, 10**k), 2)]), None, None, None, None) for k, s in enumerate("abcd") for _ in range(60)]
    rows += rows[:20] + [("q0", "dx", None, None, None, None, None, None), ("q0", "d1", "a", float("nan"), None, None, None, None), (None, "d", "a", 1.0, None, None, None, None), ("q1", None, "a", 1.0, None, None, None, None), ("q2", "d1", "other", 9e9, None, None, None, None), ("one", "d", "a", 1.0, None, None, None, None)]
    got = ranks.median_rank_order(spark.createDataFrame(rows, ROW), "q", "d", "s", "v", dict.fromkeys("abcd", 1.0))
    want = brute_order([r[:4] for r in rows], list("abcd"))
    assert {(r["q"], r["d"]): (r["median_rank"], pytest.approx(r["mean_rank"]), r["position"]) for r in got.collect()} == want


def test_no_score_decides_by_its_range(spark):
    rows = [("q", d, s, v * scale) for s, scale in (("a", 1.0), ("b", 1.0), ("c", 1e9)) for d, v in zip("xyz", {"a": (3, 2, 1), "b": (3, 2, 1), "c": (1, 2, 3)}[s])]
    order = ranks.median_rank_order(spark.createDataFrame(rows, "q string, d string, s string, v double"), "q", "d", "s", "v", dict.fromkeys("abc", 1.0)).orderBy("position")
    assert [r["d"] for r in order.collect()] == ["x", "y", "z"]
    heavy = ranks.median_rank_order(spark.createDataFrame(rows, "q string, d string, s string, v double"), "q", "d", "s", "v", {"a": 1.0, "b": 1.0, "c": 5.0}).orderBy("position")
    assert [r["d"] for r in heavy.collect()] == ["z", "y", "x"]
    assert ranks.median_rank_order(spark.createDataFrame([], ROW), "q", "d", "s", "v", {"a": 1.0}).count() == 0
