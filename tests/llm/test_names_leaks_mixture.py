"""Names, leaks and mixtures against brute force, and their edge cases."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import leaks, mixture, names


def damerau(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=5), st.text("abc", max_size=5))
def test_close_is_the_metric(a, b):
    assert names.close(a, b) == (damerau(a, b) <= 1)


def test_cells_find_every_pair(spark):
    rng = random.Random(5)
    keys = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6))) for _ in range(250)}
    df = spark.createDataFrame([("k", k, rng.randrange(9)) for k in keys] + [("k", "", 1), ("other", "ab", 1)], "kind string, key string, n long")
    got = {(r["a"], r["b"]) for r in names.key_links(df).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(keys), 2) if damerau(a, b) <= 1}


JUDGE = ["Keyal Kunash Bhanivikovarri", "K.K. Bhanivikovarri, J.", "KK Bhanivikovarri", "Bhanivikovarri, K.K.", "Keyya Bhanivikovarri", "Keyal Bhanivikovari", "Hon'ble Mr. Justice K.K.Bhanivikovarri"]
OTHER = ["Vekhark Bhetim Bhanivikovarri", "V.B. Bhanivikovarri"]
CASE = ["Kedril Hivedomeku v. State of Nilakot", "K. Hivedomeku & Ors. versus The State of Nilakot", "Hivedomeku, Kedril Vs State (Nilakot)", "Kedril Hiveedomeku V/s Nilakot State", "Kedril Hivedmoeku v State"]
OTHER_CASE = ["Sevum Hivedomeku v. State of Dolnagari", "Seva Hivedomeku versus State of Dolnagari & Anr."]
FIRM = ["Tuhivitila Jute Works Pvt. Ltd. v. Board of Revenue, Kesholi", "Tuhivitila JW. Ltd. Vs The Board of Revenue", "M/s. Tuhivitila Jute Works (P) Ltd. versus B.R., Kesholi"]


def test_variants(spark):
    rows = [("judge", n) for n in JUDGE + OTHER + ["", None, "???"]] + [("case", n) for n in CASE + OTHER_CASE + FIRM + ["v.", "x" * 5000]]
    got = {(r["kind"], r["name_a"], r["name_b"]) for r in names.name_links(spark.createDataFrame(rows + rows, "kind string, name string")).collect()}
    want = {(k, *sorted(p)) for k, group in (("judge", JUDGE), ("judge", OTHER), ("case", CASE), ("case", OTHER_CASE), ("case", FIRM)) for p in itertools.combinations(group, 2)}
    assert got == want


def test_no_names(spark):
    assert names.name_links(spark.createDataFrame([], "kind string, name string")).count() == 0


ITEM = " ".join(f"word{i} of the {w}" for i, w in enumerate("penniless cartographer buried ninety boundary stones near the ferry while loud drums played for every guest at dawn today".split()))


def test_wu_manber_against_brute_force():
    rng = random.Random(6)
    vocabulary = "abcdefg"
    items = {i: rng.choices(vocabulary, k=12) for i in range(6)}
    automaton = leaks.WuManber(items.items())
    for _ in range(50):
        doc = rng.choices(vocabulary + "xyz", k=80)
        got = {(at, i, p) for at, hits in automaton.find(doc) for i, p in hits}
        assert got == {(a, i, p) for i, w in items.items() for a in range(len(doc) - 4) for p in range(len(w) - 4) if doc[a : a + 5] == w[p : p + 5]}


def test_leaks(spark):
    w = ITEM.split()
    altered = " ".join("changed" if i % 9 == 8 else x for i, x in enumerate(w))
    docs = [
        (1, f"Before. {ITEM.upper()} After."), (2, "noise " * 900 + " ".join(w[:36])), (3, " ".join(w[:20])), (4, altered), (5, ITEM.replace("o", "о").replace("word5", "wo-\nrd5").replace(" the", "​ the")),
        (6, " ".join(reversed(w))), (7, None), (8, ""), (None, ITEM), (1, f"Before. {ITEM.upper()} After."), (9, " ".join(" ".join(w[i : i + 6]) + " xx yy zz" * 4 for i in range(0, len(w), 6))),
    ]
    d = spark.createDataFrame([(*r, 0, "x") for r in docs], "doc_id long, text string, item_id long, t string")
    items = spark.createDataFrame([(10, ITEM), (10, ITEM), (11, "too short here"), (12, None), (None, ITEM), (13, "")], "item_id long, text string")
    for pass_words in (2_000_000, 3):
        got = leaks.leaked_pairs(d, "doc_id", "text", items, "item_id", "text", pass_words)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 10), (2, 10), (4, 10), (5, 10)}
    report = {r["item_id"]: (r["leaked"], r["documents"]) for r in leaks.leak_report(got, items, "item_id").collect()}
    assert report == {10: (True, 4), 11: (False, 0), 12: (False, 0), 13: (False, 0)}
    assert leaks.leaked_pairs(d.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leaks.leaked_pairs(d, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_water_fill():
    assert mixture.water_fill(10, {"a": 1, "b": 1}, {"a": 2, "b": 50}) == {"a": 2, "b": 8}
    assert mixture.water_fill(100, {"a": 1, "b": 1}, {"a": 2, "b": 5}) == {"a": 2, "b": 5}
    assert mixture.water_fill(10, {"a": 0, "b": 1}, {"a": 2, "b": 50}) == {"a": 0.0, "b": 10}


def test_shortage_goes_to_siblings_first():
    leaves = [("d", "en", "s1", 100), ("d", "en", "s2", 1000), ("e", "en", "s3", 1000)]
    got = mixture.budgets(leaves, {"s1": (0.4, 1), "s2": (0.2, 1), "s3": (0.4, 1)}, {"s1": "d", "s2": "d", "s3": "e"}, 500)
    assert got == pytest.approx({("s1", "en"): 100, ("s2", "en"): 200, ("s3", "en"): 200})


def test_mixture(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["law", "court", "appeal", "न्याय"], k=rng.randrange(5, 40))), s, rng.choice(["en", "hi", None]), "x") for i, s in enumerate(["big"] * 900 + ["small"] * 60 + ["none"] * 20)]
    rows += rows[:5] + [(5000, None, "big", "en", "x"), (5001, "", "small", "en", "x"), (None, "text", "big", "en", "x"), (5002, "text", None, "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 5), ("absent", 0.1, 3), ("small", 0.4, 5)], "source string, target_share double, max_repeats int")
    drawn = mixture.mixture(docs, targets)
    got = drawn.collect()
    assert len({r["doc_id"] for r in got}) == len(got) and {r["source"] for r in got} == {"big", "small"}
    assert all(1 <= r["uses"] <= {"big": 1, "small": 5}[r["source"]] for r in got)
    share = {r["source"]: r["share"] for r in mixture.shares(drawn, targets).collect()}
    assert share["big"] == pytest.approx(5 / 9, abs=0.02) and share["small"] == pytest.approx(4 / 9, abs=0.02) and share["absent"] == 0
    again = {(r["doc_id"], r["uses"]) for r in mixture.mixture(docs.repartition(7), targets).collect()}
    assert again == {(r["doc_id"], r["uses"]) for r in got}
    assert mixture.mixture(docs.limit(0), targets).count() == 0 and mixture.mixture(docs, targets.limit(0)).count() == 0


def test_tokens_match_the_public_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = ["The appeal is allowed.", "न्यायालय ने कहा।", "  two\n\nlines ", "<|endoftext|>"]
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    want = [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    got = mixture.with_tokens(spark.createDataFrame([(i, x, "s", "l") for i, x in enumerate(texts)], "d int, t string, s string, l string"), "d", "t", "s", "l").orderBy("doc_id")
    assert [r["tokens"] for r in got.collect()] == want
