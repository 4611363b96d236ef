"""Sentiment rules on a hand lexicon: negation, boosters, 'but', range, empty text."""

import math

from starlens.operators import sentiment as SE


def score(spark, texts):
    lex = spark.createDataFrame([("good", 2), ("bad", -2), ("fine", 1)], "token string, valence int")
    df = spark.createDataFrame(list(enumerate(texts)), "review_id long, text string")
    out = SE.lexicon_sentiment(df, lex).select("review_id", "sentiment").collect()
    return {r[0]: r[1] for r in out}


def comp(s):
    return s / math.sqrt(s * s + SE.ALPHA)


def test_rules(spark):
    s = score(spark, ["good", "not good", "very good", "good but bad", "", None, "nothing here", "NOT Good!"])
    assert math.isclose(s[0], comp(2))
    assert math.isclose(s[1], comp(2 * SE.NEGATION))
    assert math.isclose(s[2], comp(2 + SE.BOOST))
    assert math.isclose(s[3], comp(2 * SE.BUT_BEFORE - 2 * SE.BUT_AFTER))
    assert s[4] == 0.0 and s[5] == 0.0 and s[6] == 0.0
    assert math.isclose(s[7], s[1])
    assert all(-1 <= v <= 1 for v in s.values())


def test_sentences_and_stars(spark):
    lex = spark.createDataFrame([("good", 3), ("bad", -3)], "token string, valence int")
    df = spark.createDataFrame([(1, "Good. Good!"), (2, ""), (3, "Bad. Bad? Bad.")], "review_id long, text string")
    sent = SE.sentences(df).collect()
    assert sorted((r[0], r[1]) for r in sent) == [(1, 0), (1, 1), (2, 0), (3, 0), (3, 1), (3, 2)]
    out = {r["review_id"]: r for r in SE.predict_stars(df, SE.lexicon_star_scorer(lex)).collect()}
    assert out[1]["predict_stars"] > 3 and out[3]["predict_stars"] < 3
    assert out[2]["predict_stars"] == 3


def test_arrow_scorer_plugin(spark):
    def load():
        def predict(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("model failure")
            return [5 if "great" in t.lower() else 1 for t in texts]

        return predict

    df = spark.createDataFrame(
        [(1, "Great. Great!"), (2, "Bad. Bad."), (3, "boom")], "review_id long, text string"
    )
    out = {r["review_id"]: r for r in SE.predict_stars(df, SE.arrow_scorer(load, batch_size=2)).collect()}
    assert out[1]["predict_stars"] == 5 and out[2]["predict_stars"] == 1
    assert out[3]["predict_stars"] == 3
