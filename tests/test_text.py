"""Column functions and span readers on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import spans as sp
from lexmill.functions import text as tx
from lexmill.functions.stem import stem
from lexmill.operators import zones


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    cases = {"Sections 302 and 120-B of the IPC": ["sections", "302", "120-b", "ipc"], "[2025] 1 S.C.R. 1 : 2025 INSC 8": ["2025", "1", "scr", "1", "2025", "insc", "8"], "": [], "the of and": []}
    for text, want in cases.items():
        assert one(spark, tx.tokens(F.lit(text))) == want
    assert one(spark, tx.tokens(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize("word, want", [("murder", "murder"), ("guilty", "guilti"), ("accused", "accus"), ("articles", "articl"), ("constitution", "constitut"), ("intention", "intent"), ("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("sky", "sky")])
def test_stems(word, want):
    assert stem(word) == want


def test_dates_and_grades(spark):
    assert str(one(spark, tx.iso_date(F.lit("13-02-2018")))) == "2018-02-13"
    assert one(spark, tx.iso_date(F.lit("2018-02-30"))) is None
    assert one(spark, tx.catalog_date(F.lit(""))) is None
    assert [one(spark, tx.parse_grade(F.lit(g))) for g in ("2.0", "", "7", "x")] == [2, None, None, None]
    assert one(spark, tx.bad_grade(F.lit("x"))) is True


def test_titles_parties_cells(spark):
    assert one(spark, tx.smart_title(F.lit("STATE OF U.P. versus A.B. SINGH"))) == "State of U.P. v. A.B. Singh"
    assert sorted(one(spark, tx.party_tokens(F.lit("Ram Singh v. State of Haryana & Ors.")))) == ["haryana", "ram", "singh", "state"]
    assert one(spark, tx.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert one(spark, tx.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0
    assert one(spark, tx.safe_cell(F.lit("=1+1"))) == "'=1+1"
    assert one(spark, tx.base_section(F.lit("438(1)"))) == "438" and one(spark, tx.base_section(F.lit("120-b"))) == "120B"


def test_cites():
    keys = lambda t: [c[2] for c in sp.find_cites(t)]
    assert keys("(1993) 1 Suppl. SCC 96") == ["SCC|1993|1|S|96"]
    assert keys("[2018] 10 S.C.R. 1005 and A.I.R. 1971 S.C. 673") == ["SCR|2018|10||1005", "AIR|1971|SC||673"]
    assert keys("2010 (11) SCC 3; 2025 INSC 8") == ["SCC|2010|11||3", "INSC|2025|||8"]
    assert keys("nothing here 12") == []


def test_mentions_link_short_forms():
    text = "Reliance on Ram Prakash v. State of Kesholi (2010) 4 SCC 12 was placed. In Ram Prakash (supra) it was held so."
    kinds = [(m[2], m[5]) for m in sp.mentions(text)]
    assert kinds[0][0] == "full" and ("supra", sp.mentions(text)[0][0]) in kinds


def test_legal_sentences():
    t = "96. For all these reasons, Mr. A. Khan v. State fails. It is so ordered. See s. 3."
    assert [t[a:b].strip() for a, b in sp.legal_sentences(t)] == ["96. For all these reasons, Mr. A. Khan v. State fails.", "It is so ordered.", "See s. 3."]
    assert sp.legal_sentences("") == []


def test_zones_and_coram():
    body = "\n".join(f"{i}. Paragraph {i} text." for i in range(1, 11)).replace("Paragraph 4", "The submissions of counsel").replace("Paragraph 8", "We hold that the appeal is allowed")
    z = zones.split_zones("Headnote words\n" + body)
    assert "submissions" in z["arguments"] and "We hold" in z["holding"] and "Paragraph 1" in z["facts"]
    assert zones.split_zones("") == {"headnote": "", "facts": "", "arguments": "", "holding": ""}
    assert zones.coram("X\n[A.B. LOKUR, S. NAZEER AND D. GUPTA, JJ.]\n") == ["A.B. LOKUR", "S. NAZEER", "D. GUPTA"]
    assert zones.coram("[for himself and Khan, J.]") == []
