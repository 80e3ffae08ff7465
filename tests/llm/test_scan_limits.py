"""Heads and forms beyond any number a worker could hold, and the filters that spare lookups."""

import random

from lexmill.llm import scans

TITLE = "RAM LAL\nv.\nSTATE OF KESHOLI\nMay 1, 1959\n[A AND B, JJ.]\n\n"


def _word(rng, n):
    return "".join(rng.choice("abdgkmnprsuvwz") for _ in range(n))


def test_every_recurring_head_is_known(spark):
    rng = random.Random(8)
    heads = [f"{_word(rng, 8)} {_word(rng, 9)}".upper() for _ in range(300)]
    rows = [(f"1959_2_{i}_{i + 9}_EN", f"{TITLE}The appeal fails.\n{h if k else h[:4] + 'X' + h[5:]}\nIt is so held.", "scan") for i, (h, k) in enumerate((h, k) for h in heads for k in range(4))]
    got = scans.flagged_lines(spark.createDataFrame(rows, "doc_id string, text string, layer string")).filter("page").select("doc_id", "line_no").collect()
    assert {(r["doc_id"], r["line_no"]) for r in got} == {(d, 8) for d, *_ in rows}


def test_rare_words_are_rejoined(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = [_word(rng, 9) for _ in range(2000)]
    monkeypatch.setattr(scans, "FILTER_BITS", 256)  # a filter that says yes to all: the joins alone decide
    clean = [(f"c{i}", " ".join(vocabulary) + ".", "digital") for i in range(11)]
    broken = [(f"1959_2_{i}_{i}_EN", f"{TITLE}The {w[:4]} {w[4:]} is here.", "scan") for i, w in enumerate(vocabulary[::40])]
    got = scans.flagged_lines(spark.createDataFrame(clean + broken, "doc_id string, text string, layer string")).filter("word").select("doc_id", "line_no").collect()
    assert {(r["doc_id"], r["line_no"]) for r in got} == {(d, 7) for d, *_ in broken}


def test_filters_say_no_only_to_what_is_missing(spark):
    df = spark.createDataFrame([(f"w{i}",) for i in range(500)] + [(None,), ("é़",), ("",)], "form string")
    one, none = (scans._Filter(f.value) for f in scans._filters(df, df.limit(0)))
    assert all(f"w{i}" in one for i in range(500)) and "é़" in one and "" in one
    assert sum(f"x{i}" in one for i in range(2000)) < 10 and not any(f"w{i}" in none for i in range(500))
