"""Spelling variants against a lookup of every word with one code point left out."""

import random

import brute
import pyarrow as pa
import pytest
from dnsflow.llm import common, spelling

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_query_equals_plain_code(spark):
    docs = common.table(spark, SF, "documents")
    expect = brute.spelling([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(spelling.op12_spelling_variants(spark, SF)) == expect and any(r[3] for r in expect)


@pytest.mark.parametrize("frequent,block", [(0, 2048), (3, 4), (10 ** 9, 3)])
def test_few_letters_lose_no_pair(spark, monkeypatch, frequent, block):
    monkeypatch.setattr(spelling, "FREQUENT", frequent)
    monkeypatch.setattr(spelling, "BLOCK", block)
    draw = random.Random(3)
    words = ["".join(draw.choice("abé") for _ in range(draw.randint(4, 9))) for _ in range(700)]
    rows = [(i, " ".join(draw.choices(words, k=60)) + " " + "y" * 3000 + " " + "y" * (2999 + i % 2)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(spelling.variants(df)) == brute.spelling(rows)


def test_words_that_meet_in_two_lists_in_either_order_are_one_pair():
    table = pa.table({
        "list": ["p", "p", "q", "q", "q"], "shorter": [False, False, False, False, True], "word": ["tests", "testy", "testy", "tests", "test"],
        "n": pa.array([5, 9, 9, 5, 7], pa.int64()), "size": pa.array([5, 5, 5, 5, 4], pa.int32()),
    })
    assert {tuple(r.values()) for r in spelling._near(table).to_pylist()} == {("tests", "testy", 5, 9), ("test", "tests", 7, 5), ("test", "testy", 7, 9)}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "Words words WORDS wordz wordz wordz"), (3, "words words wörds wörds wörds wörds"), (3, "words words wörds wörds wörds wörds"),
            (4, "×÷×÷×÷ ×÷×÷×÷ ×÷×÷×÷ ÀÉÎÕÜ àéîõü 漢字words漢字 words_words"), (5, "a b c d e " * 5), (6, "tests testes " * 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n", "2 AS gram", "3 AS list")
    got = spelling.variants(df)
    assert rows_of(got) == brute.spelling(rows)
    assert spelling.variants(df.limit(0)).count() == 0


def test_the_bound_holds_for_every_edit():
    draw = random.Random(1)
    for _ in range(4000):
        frequent = {"".join(draw.choices("abc", k=draw.choice((2, 3)))) for _ in range(draw.randint(0, 25))}
        ends = spelling.inner_ends(frequent)
        w = "".join(draw.choices("abc", k=draw.randint(5, 10)))
        grams, bound = spelling.decomposed(w, frequent, ends)
        at, kind = draw.randrange(len(w)), draw.choice("sdi")
        t = w[:at] + {"s": draw.choice("abc"), "d": "", "i": draw.choice("abc") + w[at]}[kind] + w[at + 1:]
        move = len(t) - len(w)
        other = {(p, t[p:e]) for p, e in spelling.decomposed(t, frequent, ends)[0]}
        kept = sum((p, w[p:e]) in other or (p + move, w[p:e]) in other for p, e in grams)
        assert kept >= len(grams) - bound, (w, t, frequent)
