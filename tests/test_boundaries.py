"""The boundary model learns from raw text; hand-written cases say where it has to cut."""

import math
import random
from collections import Counter

import pytest

from starlens.operators import boundaries as B


def _corpus():
    """Plain sentences in which dr., etc., e.g. and vol. stand with a period, within sentences and at their ends."""
    r = random.Random(1)
    words = "the house garden stone river walks sees finds old green light over under with and near they we it small village market road".split()
    names = "Smith Miller Jones Baker Taylor".split()
    out = []
    for i in range(400):
        body = [r.choice(words) for _ in range(r.randint(6, 14))]
        if i % 4 == 0:
            body[3:3] = ["Dr.", r.choice(names)]
        if i % 7 == 0:
            body[5:5] = ["stones,", "etc.,", "and", "sees"]
        if i % 9 == 0:
            body[2:2] = ["e.g.", "a", r.choice(words)]
        if i % 11 == 0:
            body[2:2] = ["vol.", str(r.randint(1, 90))]
        start = r.choice(["The", "They", "We", "It"])
        out.append(" ".join([start, *body]) + r.choice([".", ".", ".", "!", "?"]))
    return [" ".join(out[i : i + 20]) for i in range(0, 400, 20)]


@pytest.fixture(scope="module")
def model(spark):
    from starlens.session import materialise

    return materialise(B.learn_boundaries(spark.createDataFrame([(t,) for t in [*_corpus(), None, "", " "]], "text string")), "test-model")


def test_what_is_learned(model):
    rows = {r.type: r for r in model.collect()}
    assert {t for t, r in rows.items() if r.is_abbreviation} == {"dr", "e.g", "vol"}  # "etc.," never ends in its period here
    assert {"the", "they", "we", "it"} <= {t for t, r in rows.items() if r.is_starter}
    assert not rows["smith"].is_starter and rows["smith"].n_lower == 0 and rows["garden"].n_lower == rows["garden"].n


def test_scores_against_the_formulas(model):
    words = [w.strip("\"'()[]") for t in _corpus() for w in t.split()]
    kind = lambda w: w.rstrip(".!?,;:").lower()
    n = Counter(kind(w) for w in words if any(c.isalpha() for c in kind(w)))
    dot = Counter(kind(w) for w in words if w.endswith(".") and not w.endswith("..") and any(c.isalpha() for c in kind(w)))
    total, dots = sum(n.values()), sum(dot.values())
    rows = {r.type: r for r in model.collect()}
    assert {t: (r.n, r.n_dot) for t, r in rows.items()} == {t: (n[t], dot[t]) for t in n}
    for t, r in rows.items():
        p, plain, size = dots / total, n[t] - dot[t], len(t.replace(".", ""))
        null = dot[t] * math.log(p) + plain * math.log(1 - p)
        other = dot[t] * math.log(0.99) + plain * math.log(0.01)
        score = -2 * (null - other) * math.exp(-size) * (t.count(".") + 1) * size ** -float(plain)
        assert r.is_abbreviation == (dot[t] > 0 and score >= 0.3)


CASES = [
    ("Dr. Smith sees the house. They walk.", ["Dr. Smith sees the house.", "They walk."]),
    ("We find the river, e.g. near the road. It is old.", ["We find the river, e.g. near the road.", "It is old."]),
    ("They came on 3. May to the market. The light is green.", ["They came on 3. May to the market.", "The light is green."]),
    ("See vol. 7 of it. We do.", ["See vol. 7 of it.", "We do."]),
    ("J. Smith and A. Baker walk. Is it old? Yes! It is.", ["J. Smith and A. Baker walk.", "Is it old?", "Yes!", "It is."]),
    ("The village has a Dr. They see it.", ["The village has a Dr.", "They see it."]),
    ('He said "It is old." They walk (near the road.) We see.', ['He said "It is old."', "They walk (near the road.)", "We see."]),
    ("It walks on... and on. The end.", ["It walks on... and on.", "The end."]),
    ("It stops... The light is green.", ["It stops...", "The light is green."]),
    ("no mark at the end", ["no mark at the end"]),
    ("  two.\n\nlines.\t", ["two.", "lines."]),
    ("", [""]),
    (None, [""]),
    (" \n ", [""]),
    ("Dr.", ["Dr."]),
    ("Dr.   Smith.", ["Dr. Smith."]),
]


def test_cases(spark, model):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "review_id long, text string")
    got = {}
    for r in B.split_sentences(df, model).collect():
        got.setdefault(r.review_id, {})[r.pos] = r.sentence
    for i, (t, want) in enumerate(CASES):
        assert [got[i][k] for k in range(len(got[i]))] == want, t


def test_no_corpus(spark):
    empty = B.learn_boundaries(spark.createDataFrame([], "text string"))
    assert empty.collect() == []
    df = spark.createDataFrame([(1, "One. Two."), (2, "A. B")], "review_id long, text string")
    assert sorted(tuple(r) for r in B.split_sentences(df, empty).collect()) == [(1, 0, "One."), (1, 1, "Two."), (2, 0, "A. B")]


def test_patterns_see_each_distinct_token_once(spark, monkeypatch):
    written, kept = {}, B.materialise
    monkeypatch.setattr(B, "materialise", lambda d, name: written.setdefault(name, kept(d, name)))
    counts = B.type_counts(spark.createDataFrame([("A word. A word. A word",)], "text string"))
    assert {(r.t, r.c) for r in written["boundary-tokens"].collect()} == {("A", 3), ("word.", 2), ("word", 1)}
    assert {r.type: (r.n, r.n_dot, r.n_capital) for r in counts.collect()} == {"a": (3, 0, 0), "word": (3, 2, 0)}
