"""Edge rows for the text / feature rules."""

import math

import pytest
from pyspark.sql import functions as F

from starlens.functions import features as X
from starlens.functions import text as T


def one(spark, rows, schema, expr):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr).collect()]


def test_merge_text_period(spark):
    rows = [(None, None), ("", "x"), ("  ", "x"), ("t", None), ("t\t", "\nx"), (" t ", "y")]
    got = one(spark, rows, "title string, text string", T.merge_text("title", "text", ". ", strip=True))
    assert got == ["", "x", "x", "t", "t. x", "t. y"]


def test_merge_text_space(spark):
    rows = [(None, None), ("a", None), (None, "b"), ("a", "b")]
    got = one(spark, rows, "title string, text string", T.merge_text("title", "text", " "))
    assert got == [" ", "a ", " b", "a b"]


def test_word_count_unicode_whitespace(spark):
    rows = [("a  b c",), (None,), ("",), ("   ",), ("one\ttwo\nthree　four",)]
    assert one(spark, rows, "t string", T.word_count("t")) == [3, 0, 0, 0, 4]


def test_misleading_null_and_nan(spark):
    rows = [(4.0, 3), (5.0, 3), (1.0, 3), (None, 3), (float("nan"), 3)]
    got = one(spark, rows, "p double, r int", X.misleading("p", "r"))
    assert got == [False, True, True, False, False]


@pytest.mark.parametrize(
    "words,label",
    [(0, None), (1, "Very Short"), (20, "Very Short"), (21, "Short"), (50, "Short"), (51, "Medium"),
     (100, "Medium"), (101, "Long"), (200, "Long"), (201, "Very Long")],
)
def test_length_bucket5(spark, words, label):
    assert one(spark, [(words,)], "w int", X.length_bucket5("w")) == [label]


def test_length_bucket2_and_group(spark):
    rows = [(49, True), (50, False), (50, None)]
    df = spark.createDataFrame(rows, "w int, v boolean")
    got = df.select(X.group_label(X.length_bucket2("w"), "v"), X.group_label(X.length_bucket2("w"), "v", "verified_first")).collect()
    assert [tuple(r) for r in got] == [
        ("Short + Verified", "Verified + Short"),
        ("Long + Unverified", "Unverified + Long"),
        ("Long + Unverified", "Unverified + Long"),
    ]


def test_clean_text_rules(spark):
    rows = [("<b>Hi</b>",), ("a &amp; b",), ("café!",), ("don't",), ("lol",), ("lollipop",), ("BRB",),
            ("x<script>var a=1;</script>y",), ("p<!-- c -->q",), (None,)]
    got = one(spark, rows, "t string", T.clean_text("t"))
    assert got == ["hi", "a  b", "café", "dont", "laughing out loud", "laughing out loudlipop", "be right back",
                   "xy", "pq", ""]


def test_clean_text_word_boundary(spark):
    got = one(spark, [("lol lollipop",)], "t string", T.clean_text("t", word_boundary=True))
    assert got == ["laughing out loud lollipop"]


def test_time_weight(spark):
    ref = X.ref_epoch_ms()
    rows = [(ref,), (ref - 1,), (ref - 86_400_000 * 365,), (ref + 86_400_000 * 365,), (None,)]
    got = one(spark, rows, "ts bigint", X.time_weight("ts"))
    assert got[0] == 1.0 and got[1] == 1.0
    assert math.isclose(got[2], math.exp(-1))
    assert math.isclose(got[3], math.exp(1))
    assert got[4] == 0.0


def test_image_count_and_epoch(spark):
    rows = [(None, 0), ([], 1), (["a", "b", "c"], 2)]
    assert one(spark, rows, "im array<string>, x int", X.image_count("im")) == [0, 0, 3]
    got = one(spark, [(0,), (None,), (10**18,)], "ms bigint", X.epoch_ms("ms"))
    assert got[0] is not None and got[1] is None and got[2] is None


def test_half_even_round(spark):
    assert one(spark, [(2.5,), (3.5,)], "x double", F.bround("x", 0)) == [2.0, 4.0]


def test_truncate(spark):
    got = one(spark, [("a" * 400,), ("a" * 401,)], "t string", T.truncate_text("t", 400))
    assert got == ["a" * 400, "a" * 400 + "..."]


def test_tokens(spark):
    got = one(spark, [("Héllo wörld a_b x 42",)], "t string", T.tokens("t"))
    assert got == [["héllo", "wörld", "a_b", "42"]]
