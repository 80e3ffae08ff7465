"""Sentence rules, scan repair and truncation on hand-made texts, and their edge cases."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import scans, sentences, truncation


def cut(text):
    return [text[a:b] for a, b in sentences.sentence_spans(text)]


@pytest.mark.parametrize(
    "want",
    [
        ["1. Mr. A. Khan paid Rs. 4.50 to M/s. B. Lal & Co. at 5.30 p.m. on 02.03.1999.", "It was so held."],
        ["HELD:", "2. The appeal is allowed."],
        ['The accused replied: "It is false. I was away." and left.', "What then?", "Nothing!"],
        ["See A.I.R. 1971 S.C. 673.", "Reliance on 1999 Supp. (2) SCR 3 (see (1987) 5 S.C.C. 2) failed."],
        ['"Nobody came to our help!" cried A. B.'],
        ["अदालत ने रु. 5.50 दिए।", "डॉ. राम चुप रहे|", "क्या हुआ?"],
        ['गवाह ने कहा, "मैं नहीं था। मुझे छोड़ो।" और चुप रहे।', "बस।"],
        ["عدالت نے دفعہ 3 مانا۔", "گواہ گیا۔"],
        ["திரு. வேசுகன் ரூ. 2.75 தந்தார்.", "நன்று!"],
        ["... but that was all.", "We agree."],
    ],
)
def test_sentences(want):
    assert cut(" ".join(want) if want[0] != "HELD:" else "\n".join(want)) == want


def test_sentences_without_spaces():
    assert cut("法院说：“我不在。我在家。”他走了。好！") == ["法院说：“我不在。我在家。”", "他走了。", "好！"]
    assert cut("It was an abrasion.The view was doubted.Mr. Khan left.") == ["It was an abrasion.", "The view was doubted.", "Mr. Khan left."]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='ab A.?!"()\n।。1,“”|…', max_size=60))
def test_every_character_in_one_sentence(text):
    spans = sentences.sentence_spans(text)
    inside = [i for a, b in spans for i in range(a, b)]
    assert len(inside) == len(set(inside)) and {i for i, c in enumerate(text) if not c.isspace()} <= set(inside)
    assert all(text[a:b] == text[a:b].strip() for a, b in spans)


def test_sentence_operator_edges(spark):
    rows = [("a", None, "x"), ("b", "", "x"), ("c", "  \n ", "x"), (None, "One. Two.", "x"), ("d", "Long words here. " * 20_000, "x")]
    got = sentences.sentences(spark.createDataFrame(rows, "k string, t string, key string"), "k", "t").groupBy("key").count().collect()
    assert {r["key"]: r["count"] for r in got} == {None: 2, "d": 20_000}
    assert sentences.sentences(spark.createDataFrame([], "k string, t string"), "k", "t").count() == 0


TITLE = "RAM LAL\nv.\nSTATE OF KESHOLI\nMay 1, 1959\n[A AND B, JJ.]\n\n"
GOOD = "The learned counsel for the appellant submitted that the recovery was not proved. The evidence was recorded by the officer during the summer recess. " * 4


def docs(spark, texts, layer="scan"):
    rows = [(d, t, layer, "x", 1) for d, t in texts.items()] + [(f"c{i}", GOOD, "digital", "x", 1) for i in range(5)]
    return spark.createDataFrame(rows, "doc_id string, text string, layer string, line string, n int")


def flags(spark, text, doc="1959_2_301_309_EN"):
    rows = scans.flagged_lines(docs(spark, {doc: text})).collect()
    return {r["line_no"] - 6: (r["page"], r["carried"], r["word"]) for r in rows if not r["title"] and r["line"].strip() and (r["page"] or r["carried"] or r["word"])}


def test_scan_lines(spark):
    body = ["The learned counsel for thc appellant sub-", "RAM LAL v. STATE OF KES .... 303", "[303]", "A", "mitted that the recovery was not proved.   B", "The evidence was rec orded by the off•icer during the", "summer recess.", "303"]
    assert flags(spark, TITLE + "\n".join(body)) == {1: (False, True, True), 2: (True, False, False), 3: (True, False, False), 4: (True, False, False), 5: (False, False, True), 6: (False, False, True), 8: (True, False, False)}


def test_scan_paragraphs(spark):
    body = "The learned counsel for thc appellant sub-\n\nRAM LAL v. STATE OF KES .... 303\n[303]\nmitted that the recovery was not proved.\n\n2. The evidence was rec orded by the off•icer."
    rows = scans.paragraphs(scans.flagged_lines(docs(spark, {"1959_2_301_309_EN": TITLE + body}))).orderBy("par_no").collect()
    assert [r["text"] for r in rows][1:] == ["The learned counsel for the appellant submitted that the recovery was not proved.", "2. The evidence was recorded by the officer."]


def test_scan_edges(spark):
    empty = spark.createDataFrame([], "doc_id string, text string, layer string")
    assert scans.flagged_lines(empty).count() == 0 and scans.paragraphs(scans.flagged_lines(empty)).count() == 0
    rows = spark.createDataFrame([("a", None, "scan"), (None, "x", "scan"), ("b", "", "scan"), ("c", "word " * 20_000, None), ("d", "\n\n", "scan")], "doc_id string, text string, layer string")
    got = scans.flagged_lines(rows, spark.createDataFrame([(None, None), ("d", "x"), ("d", None)], "path string, pdf_key string")).collect()
    assert {r["doc_id"] for r in got} == {"b", "d"} and not any(r["page"] or r["word"] or r["carried"] for r in got)


def test_skeletons_meet():
    for right, wrong in {"under": "urider", "information": "inforrnation", "auditor": "auclitor", "with": "wlth", "that": "tbat", "record": "rec0rd", "brawl": "bravvl", "suspicion": "siispicion", "learned": "learried"}.items():
        assert scans.skeleton(right) == scans.skeleton(wrong)
    assert scans.skeleton("evidence") != scans.skeleton("sentence")


@pytest.mark.parametrize("text, want", [("It was so held.", "closed"), ("The view of Mr.", "broken"), ("He said: \"It is false.", "broken"), ("A sum of Rs. 48.", "broken"), ("heard by the pat�", "marked"), ("in the li\\u09", "marked"), ("The High Court (more)", "marked"), ("conduct o...", "marked"), ("the matter rests ...", "open"), ("in the presence of", "open"), ("", "closed"), ("held.\n(A. KHAN)\nJ", "closed"), ("की।", "closed"), ("की|", "closed"), ("Crl. M.P. No. 28.", "closed")])
def test_endings(text, want):
    assert truncation.ending(text) == want


def test_measures():
    t = 'é<b>&"\n'
    want = {"chars": 7, "utf8": 8, "utf16": 7, "html": 7 + 6 + 4 + 5, "html_text": 17, "json": 9, "json_ascii": 14, "crlf": 8}
    assert {k: truncation.MEASURES[k](t) for k in want} == want


def test_hidden_limit_in_utf8(spark):
    rows = []
    for i in range(60):
        full = f"Document {i} {'é' * (i % 7)} speaks of the evidence of the officer in the case. " * 9
        cutoff = full.encode()[:300].decode(errors="ignore")
        rows.append((i, cutoff if i % 2 else f"Document {i}. " + "It was held. " * (i % 13), "short" if i % 2 else "free", "x"))
    rows += [(1000, None, "short", "x"), (1001, "", None, "x"), (None, "lost", "short", "x"), rows[1]]
    found, limits = truncation.truncated(spark.createDataFrame(rows, "id long, body string, src string, text string"), "id", "body", "src")
    assert [(r["source"], r["measure"], r["field_limit"]) for r in limits.collect()] == [("short", "utf8", 300)]
    assert {r["doc_id"] for r in found.filter("truncated").collect()} == {i for i in range(60) if i % 2}
    none, no_limits = truncation.truncated(spark.createDataFrame([], "id long, body string, src string"), "id", "body", "src")
    assert none.count() == 0 and no_limits.count() == 0


def test_limit_of_cuts_moved_to_a_word_end(spark):
    rng = random.Random(3)
    words = "an officer speaks of particular proceedings and examination in this circumstance before the magistrate".split()
    marks = ["", " (more)", " [...]", "…"]
    rows = []
    for i in range(60):
        full = " ".join(rng.choice(words) for _ in range(90))
        rows.append((i, full[: full.rfind(" ", 0, 301)] + marks[i % 4], "notes"))
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(1 + i % 15)) + " was held.", "notes") for i in range(200)]
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(1 + i % 70)) + " was held.", "free") for i in range(150)]
    found, limits = truncation.truncated(spark.createDataFrame(rows, "id long, body string, src string"), "id", "body", "src")
    got = [(r["source"], r["field_limit"]) for r in limits.collect()]
    longest = max(len(b) - len(marks[i % 4]) for i, b, _ in rows[:60])
    assert got == [("notes", longest)]
    states = {r["doc_id"]: r for r in found.collect()}
    assert all(states[i]["truncated"] and states[i]["at_limit"] for i in range(60))
    assert not any(r["truncated"] for d, r in states.items() if d >= 100)
