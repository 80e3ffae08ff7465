"""Rules see whole texts: long quotations, long words, long runs of blanks; time stays linear."""

import time

from lexmill.llm import sentences


def cut(text):
    return [text[a:b] for a, b in sentences.sentence_spans(text)]


def test_long_quotations_stay_in_their_sentence():
    for opens, closes in (('"', '"'), ("“", "”"), ("(", ")"), ("「", "」")):
        inner = "It was said. I was away. " * 200
        text = f"The accused replied: {opens}{inner}{closes} and left. What then?"
        assert cut(text) == [text[: -len(" What then?")], "What then?"]


def test_brackets_left_open_enclose_nothing():
    assert cut("See (above. We agree. The rest fails.") == ["See (above.", "We agree.", "The rest fails."]
    assert cut("One (two (three. Four). Five. Six.") == ["One (two (three. Four).", "Five.", "Six."]


def test_context_of_any_length():
    blanks = " " * 500
    assert cut(f"It ended.\n{blanks}12.{blanks}The appeal fails.") == ["It ended.", f"12.{blanks}The appeal fails."]
    assert cut(f"Here {'A.B.' * 100} Khan sat. He left.") == [f"Here {'A.B.' * 100} Khan sat.", "He left."]
    assert cut("है " + "7 " * 200 + "। बस।") == ["है " + "7 " * 200 + "।", "बस।"]


def test_hostile_texts_take_linear_time():
    for unit in ("(", '"', "(a. ", "A.", "1. ", "।7 ", ". ", "A.B ", "x" * 50 + "."):
        began = time.time()
        sentences.sentence_spans(unit * 20_000 + "end")
        assert time.time() - began < 15, unit
