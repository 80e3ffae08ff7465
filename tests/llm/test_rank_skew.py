"""One value or one group that holds most rows, and systems beyond those known."""

from lexmill.llm import ranks
from lexmill.llm.rank_queries import hit_order


def test_constant_scores_and_a_hot_group_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SLICE_ROWS", 50)
    rows = [("hot", f"d{i:04}", s, v) for i in range(600) for s, v in (("a", 1.0), ("b", float(i % 3)))] + [("cold", "x", "a", 2.0)]
    got = ranks.median_rank_order(spark.createDataFrame(rows, "q string, d string, s string, v double"), "q", "d", "s", "v", {"a": 1.0, "b": 1.0}).orderBy("position").collect()
    hot = [r for r in got if r["q"] == "hot"]
    assert [r["position"] for r in hot] == list(range(1, 601))
    assert [r["d"] for r in hot] == sorted((r["d"] for r in hot), key=lambda d: (-(int(d[1:]) % 3), d))
    assert {r["median_rank"] for r in hot} == {(300.5 + m) / 2 for m in (100.5, 300.5, 500.5)}


def test_ranges_hold_a_bounded_part_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SLICE_ROWS", 50)
    from pyspark.sql import functions as F

    df = spark.range(1000).select(F.lit("g").alias("g"), F.col("id").alias("v"))
    seen = {}
    real = ranks.materialise

    def spy(t, name):
        out = real(t, name)
        seen[name] = [r["n"] for r in out.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()]
        return out

    monkeypatch.setattr(ranks, "materialise", spy)
    got = ranks.ranked(df, ["g"], "v", "r").collect()
    assert all(r["r"] == 1000 - r["v"] for r in got) and len(got) == 1000
    assert max(seen["ranges"]) <= 150 and sum(seen["ranges"]) == 1000


def test_every_system_counts(spark):
    rows = [("q", d, f"s{k}", v if k < 3 else -v) for k in range(7) for d, v in (("x", 3.0), ("y", 2.0), ("z", 1.0))]
    order = [r["doc_id"] for r in hit_order(spark.createDataFrame(rows, "qid string, doc_id string, system_name string, rel double")).orderBy("position").collect()]
    assert order == ["z", "y", "x"]
    assert hit_order(spark.createDataFrame([], "qid string, doc_id string, system_name string, rel double")).count() == 0
