"""Orphan references against a brute-force reading of the definition."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lexmill.operators import orphans
from lexmill.operators.orphans import Reference, orphan_report, orphan_rows

REF = "row_id long, key string, at timestamp, rng string, stays string"
PAR = "key string, since timestamp, until timestamp, src_table string, ord int"
T0 = datetime(2020, 1, 1)


def brute(refs, pars):
    norm = lambda k: k.strip().lower()
    stays = [(norm(k), s, u) for k, s, u, *_ in pars if k is not None and s is not None]
    return {(r, k) for r, k, t, *_ in refs if k is not None and not (t is not None and any(p == norm(k) and s <= t and (u is None or u > t) for p, s, u in stays))}


def run(spark, refs, pars, **kw):
    rows = orphan_rows({"a": Reference(spark.createDataFrame(refs, REF), "row_id", "key", "at")}, spark.createDataFrame(pars, PAR), "key", "since", "until", **kw)
    got = [(r["row_id"]) for r in rows.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_brute_force(spark):
    rng = random.Random(3)
    pars, refs = [], []
    for i in range(150):
        at = T0 + timedelta(hours=rng.randrange(20_000))
        until = None if rng.random() < 0.4 else at + timedelta(hours=rng.randrange(-5, 8000))
        pars.append((f"k{i % 110}", at, until, "x", 1))
    for i in range(600):
        k = f"k{rng.randrange(130)}"
        refs.append((i, rng.choice([k, f" {k}", k.upper(), f"{k}\t"]), T0 + timedelta(hours=rng.randrange(22_000)), "c", "d"))
    want = {r for r, _ in brute(refs, pars)}
    for ranges in (None, 1, 7):
        assert run(spark, refs + refs[:50], pars + pars[:20], ranges=ranges) == want


def test_borders(spark):
    pars = [("a", datetime(2020, 1, 1), datetime(2020, 2, 1), None, None)]
    at = [datetime(2020, 1, 1), datetime(2020, 1, 31, 23, 59, 59), datetime(2020, 2, 1), datetime(2019, 12, 31, 23, 59, 59)]
    assert run(spark, [(i, "a", t, None, None) for i, t in enumerate(at)], pars) == {2, 3}


def test_nulls_blanks_and_empty_tables(spark):
    pars = [("a", T0, None, None, None), (None, T0, None, None, None), ("b", None, None, None, None), ("", T0, None, None, None), ("c", T0, T0 - timedelta(1), None, None)]
    refs = [(1, None, T0, None, None), (2, "a", None, None, None), (3, "b", T0, None, None), (4, "  ", T0, None, None), (5, "c", T0, None, None), (6, "x" * 100_000, T0, None, None)]
    assert run(spark, refs, pars) == {2, 3, 5, 6}
    assert run(spark, refs, []) == {2, 3, 4, 5, 6}
    assert run(spark, [], pars) == set()


def test_report_counts_rows_and_keys(spark):
    refs = [(1, "x", datetime(2021, 3, 4), None, None), (2, "X ", datetime(2021, 3, 9), None, None), (3, "y", None, None, None)]
    r = orphan_report({"a": Reference(spark.createDataFrame(refs, REF), "row_id", "key", "at")}, spark.createDataFrame([], PAR), "key", "since", "until")
    assert {tuple(x) for x in r.collect()} == {("a", "2021-03", 2, 1), ("a", None, 1, 1)}


def test_ranges_follow_the_keys_of_both_sides(spark, monkeypatch):
    monkeypatch.setattr(orphans, "KEYS_PER_RANGE", 50)
    seen = {}
    real = orphans._encoded

    def spy(rows, parents, key, since, until, ranges):
        out = real(rows, parents, key, since, until, ranges)
        seen["most"] = max(r["count"] for r in out.groupBy("rng").agg({"ord": "max"}).select(F.col("max(ord)").alias("count")).collect())
        return out

    monkeypatch.setattr(orphans, "_encoded", spy)
    at = datetime(2020, 1, 5)
    refs = spark.createDataFrame([(i, f"missing{i}" if i % 3 else "hot", at) for i in range(1500)], "id long, k string, t timestamp")
    empty = spark.createDataFrame([], "k string, a timestamp, b timestamp")
    found = orphans.orphan_rows({"r": orphans.Reference(refs, "id", "k", "t")}, empty, "k", "a", "b")
    assert found.count() == 1500
    assert seen["most"] < 100
