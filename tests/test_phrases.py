"""Phrase rules of the lexicon sentiment on hand-checked sentences."""

import math

import pytest

from starlens.operators import phrases as P
from starlens.operators import sentiment as SE

N, B = SE.NEGATION, SE.BOOST
CASES = [
    ("good", 2),
    ("kind of good", 2 - B),
    ("kind good", 2),
    ("kind of very good", 2 + B - B),
    ("kind of bad", -2 - B),
    ("never so good", (2 + B) * P.STRENGTH),
    ("never this good", 2 * P.STRENGTH),
    ("never very so good", ((2 + B) + 0.95 * B) * P.STRENGTH),
    ("never good", 2 * N),
    ("without doubt good", 2),
    ("without a doubt good", 2),
    ("without good", 2 * N),
    ("not very good", (2 + B) * N),
    ("not so very good", ((2 + B) + 0.95 * B) * N),
    ("very not good", 2 * N - 0.95 * B),
    ("least good", 2 * N),
    ("least bad ones", -2 * N),
    ("at least good", 2),
    ("very least good", 2 + 0.95 * B),
    ("least of all good", 2),
    ("kiss of death", -1.5),
    ("not a kiss of death", -1.5),
    ("that is the bomb", 3),
    ("bomb", -1),
    ("bad ass man but bad", 1.5 * SE.BUT_BEFORE - 2 * SE.BUT_AFTER),
    ("", 0),
    (None, 0),
    ("nothing to see", 0),
]


@pytest.fixture(scope="module")
def lex(spark):
    rows = [("good", 2.0), ("bad", -2.0), ("death", -3.0), ("bomb", -1.0)]
    return spark.createDataFrame(rows, "token string, valence double")


def test_hand_checked_sentences(spark, lex):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id long, t string")
    got = {r["id"]: r["sentiment"] for r in P.score_phrases(df, ["id"], "t", lex).collect()}
    want = {i: s / math.sqrt(s * s + SE.ALPHA) for i, (_, s) in enumerate(CASES)}
    wrong = {CASES[i][0]: (got.get(i), w) for i, w in want.items() if not math.isclose(got.get(i, 9), w, abs_tol=1e-12)}
    assert not wrong and len(got) == len(CASES)


def test_own_idioms_and_empty_table(spark, lex):
    df = spark.createDataFrame([(1, "good for nothing"), (2, "kiss of death")], "id long, t string")
    got = {r["id"]: r["sentiment"] for r in P.score_phrases(df, ["id"], "t", lex, idioms={"good for nothing": -2.5}).collect()}
    assert math.isclose(got[1], -2.5 / math.sqrt(2.5**2 + SE.ALPHA)) and math.isclose(got[2], -3 / math.sqrt(9 + SE.ALPHA))
    assert P.score_phrases(df.where("id > 9"), ["id"], "t", lex).collect() == []
