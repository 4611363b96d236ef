"""Markup as the HTML standard reads it, on hand-written cases."""

import time

import pytest
from pyspark.sql import functions as F

from starlens.functions.markup import markup_text, strip_markup
from starlens.functions.text import clean_text

CASES = [
    ('<a title="x > y">t</a> u', "t u"),
    ("<a title='x > \"y'>t</a>", "t"),
    ('<a title = "x>" b>t', "t"),
    ("<a b\"c>t\">u", 't">u'),
    ('t <a title="x>y', "t "),
    ("a <!-- open <b>c", "a "),
    ("a<!-- b --><!--> c<!---> d<!-- e --!> f", "a c d f"),
    ("a <script>if (x < 3) '<b>'</script> b", "a  b"),
    ("a <SCRIPT src='>'>x</b></script >b", "a b"),
    ("a <style>p{} b", "a "),
    ("<script>x</scripty>y</script>z", "z"),
    ("5 < 10 <3 > 2 & 1", "5 < 10 <3 > 2 & 1"),
    ("a</>b</ c>d<?php e ?>f<!DOCTYPE html>g", "abdfg"),
    ("&lt;b&gt; &amp;lt; &CounterClockwiseContourIntegral; &copy 2020 &#65;&#x42; &nosuch;", "<b> &lt; ∳ © 2020 AB &nosuch;"),
    ("<p>a<br/>b</p>", "ab"),
    ("plain", "plain"),
    ("", ""),
    ("a <", "a <"),
    ("a </", "a </"),
]


@pytest.mark.parametrize("raw,text", CASES)
def test_hand_written_cases(raw, text):
    assert markup_text(raw) == text


@pytest.mark.parametrize("part", ["<", "<!--", "<a b='", "</", "<script>", "<a =", "&", "<!", '"', "<a>", "</script"])
def test_linear_time_on_repeated_openings(part):
    began = time.time()
    markup_text(part * 200_000)
    assert time.time() - began < 10


def test_column(spark):
    rows = [(i, raw) for i, (raw, _) in enumerate(CASES)] + [(99, None)]
    got = dict(spark.createDataFrame(rows, "i long, t string").select("i", strip_markup(F.col("t"))).collect())
    assert got == {**{i: t for i, (_, t) in enumerate(CASES)}, 99: None}


def test_cleaning_through_it(spark):
    df = spark.createDataFrame([('<a title="x > y">Good</a>, lol',), (None,)], "t string")
    assert [r[0] for r in df.select(clean_text("t", strip=strip_markup)).collect()] == ["good laughing out loud", ""]
