"""The cascade step by step, one page that most mentions cite, mentions built from texts with their flags."""

from pyspark.sql import functions as F

from lexmill.functions import spans as sp
from lexmill.operators import citations as ci

JUDGED = [
    ("2018_13_5_40_EN", "Gopal Vishwanath v. State of Kesholi", 2018, 3, ["[2018] 13 SCR 5"]),
    ("2013_17_100_180_EN", "Zumil Raghodan v. Vekel Dozokevepu", 2013, 2, ["[2013] 17 SCR 100", "(2014) 2 SCC 1"]),
    ("2013_17_900_990_EN", "Pughav Nuyotigasi v. State of Tembari", 2013, None, ["[2013] 17 SCR 900"]),
]


def judged(spark, texts=()):
    rows = [(*j, dict(texts).get(j[0])) for j in JUDGED]
    return spark.createDataFrame(rows, "doc_id string, title string, year int, bench int, reporter_citations array<string>, text string")


def resolve(spark, rows):
    j = judged(spark)
    m = spark.createDataFrame(rows, "mention_id string, keys array<string>, name string, year int")
    got = ci.resolved(m, ci.corpus_keys(j), ci.page_ranges(j), j.select("doc_id", "title", "year")).collect()
    assert len(got) == len(rows)
    return {r["mention_id"]: (r["doc_id"] and r["doc_id"][:11], r["method"]) for r in got}


def test_cascade(spark):
    got = resolve(
        spark,
        [
            ("key", ["SCR|2018|13||5"], "", 2018),
            ("parallel", ["SCC|2014|2||1", "SCR|2013|17||100"], "", 2013),
            ("disagree", ["SCC|2014|2||1", "SCR|2018|13||5"], "", 2013),
            ("pinpoint", ["SCR|2013|17||150"], "Zumil Raghodan v. Vekel Dozokevepu", 2013),
            ("misprint", ["SCR|2013|17||950"], "Zumil Raghodan v. Vekel Dozokevepu", 2013),
            ("nameless range", ["SCR|2013|17||150"], "", 2013),
            ("stranger in range", ["SCR|2013|17||150"], "Nobody Known v. Someone Else", 2013),
            ("name", [], "Gopal Vishwanath v. State of Kesholi", None),
            ("wrong year", [], "Gopal Vishwanath v. State of Kesholi", 2001),
            ("nothing", [], "", None),
            ("null name", ["AIR|1950|SC||1"], None, 1950),
        ],
    )
    assert got == {
        "key": ("2018_13_5_4", "cite"), "parallel": ("2013_17_100", "cite"), "disagree": (None, "none"), "pinpoint": ("2013_17_100", "scr_range"), "misprint": ("2013_17_100", "name"),
        "nameless range": (None, "none"), "stranger in range": (None, "none"), "name": ("2018_13_5_4", "name"), "wrong year": (None, "none"), "nothing": (None, "none"), "null name": (None, "none"),
    }


def test_a_page_that_most_mentions_cite_is_one_row_of_the_window(spark):
    hot = spark.range(3000).select(F.col("id").alias("mention_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("SCR|2013|17||"), F.col("id") % 999)).otherwise("SCR|2013|17||150").alias("key"))
    got = ci.by_range(hot, ci.page_ranges(judged(spark)))
    assert got.filter("mention_id % 3 <> 0").count() == 2000
    want = sum(100 <= i % 999 <= 180 or 900 <= i % 999 <= 990 for i in range(0, 3000, 3))
    assert got.filter("mention_id % 3 = 0").count() == want


TEXT = (
    "Pughav Nuyotigasi v. State of Tembari CRIMINAL APPELLATE JURISDICTION. The court below erred. Reliance was placed on Gopal Vishwanath v. State of Kesholi [2018] 13 SCR 5 by counsel. "
    "Vishwanath was distinguished. The impugned judgment in Kuzil Monod v. Harap Zelin, AIR 1990 Kesholi 7 is set aside. So ordered."
)


def test_mentions_built_from_texts(spark):
    rows = ci.built(judged(spark, {"2013_17_900_990_EN": TEXT, "2018_13_5_40_EN": ""})).orderBy("start").collect()
    got = [(r["kind"], r["cited_doc"] and r["cited_doc"][:7], r["method"], r["is_self"], r["appeal_history"], r["in_headnote"], r["citing_bench"], r["cited_bench"]) for r in rows]
    assert got == [
        ("name", "2013_17", "name", True, False, True, None, None), ("full", "2018_13", "cite", False, False, False, None, 3),
        ("alias", "2018_13", "cite", False, False, False, None, 3), ("full", None, "none", False, True, False, None, None),
    ]
    assert "[[Vishwanath]] was distinguished." in rows[2]["window"] and rows[2]["window"].startswith("Reliance") and "So ordered" not in rows[2]["window"]
    assert ci.built(judged(spark)).count() == 0


def test_windows_are_bounded_and_short_forms_known():
    long = "word " * 600
    text = f"Before this. {long}Ram Lodhan v. State of Kesholi (2010) 4 SCC 12 {long}. After that."
    (s, e, *_, window, context) = next(w for w in sp.windows(text) if w[2] == "full")
    assert "[[Ram Lodhan v. State of Kesholi (2010) 4 SCC 12]]" in window and len(window) <= sp.MOST_WINDOW + 4 and len(context) <= e - s + 2 * sp.APPEAL_REACH
    assert sp.aliases("Ram Singh & Ors. v. State of Kesholi") == ["Ram Singh"]
    assert sp.aliases("State of Kesholi v. Gopal Vishwanath") == ["Gopal Vishwanath", "Vishwanath"]
    assert sp.aliases("Union of India v. Commissioner") == []
