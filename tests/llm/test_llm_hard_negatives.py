import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starlens.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, ID string, Score double, rb long"


def brute(rows, every=50, positives=5, negatives=3):
    ok = [(k, lab, v) for k, v, lab in rows if k is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = [(k, (lab + 1) % 10 if k % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for k, lab, v in ok]
    out = []
    for a in sorted({k for k, _, _ in ok if k % every == 0}):
        _, lab, va = min(x for x in ok if x[0] == a)
        s = [(-sum(x * y for x, y in zip(va, v)), k, other != lab) for k, other, v in ok if k != a and len(v) == len(va)]
        s = sorted(x for x in s if -(1 << 63) <= -x[0] < 1 << 63)
        for p, pid, _ in [x for x in s if not x[2]][:positives]:
            near = [(k, -n) for n, k, other in s if other and 50 * -p <= 100 * -n and 100 * -n <= 95 * -p]
            out += [(a, pid, i + 1, k, -p, n) for i, (k, n) in enumerate(near[:negatives])]
    return sorted(out)


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", 0.5, 1) for r in rows], SCHEMA)
    got = H.mine(df, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    out = sorted(map(tuple, got.collect()))
    assert out == brute(rows, options.get("every", 50))
    return out


@pytest.mark.parametrize("row_block", [7, 5000])
def test_random_vectors_in_blocks(spark, row_block):
    r = random.Random(1)
    rows = [(i, [r.gauss(0.3, 1) for _ in range(6)], r.randrange(3)) for i in range(300)]
    assert check(spark, rows, row_block=row_block, anchor_block=3)


def test_edge_rows(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(3)], r.randrange(3)) for i in range(120)]  # many ties
    rows += [(0, [0.1, 0.2, 0.3], 1), (1, [9.0, 9.0, 9.0], 2), (1, [9.0, 9.0, 9.0], 2), rows[50], rows[50]]  # repeated ids and rows
    rows += [(None, [1.0, 1.0, 1.0], 1), (200, None, 1), (201, [1.0, 1.0, 1.0], None), (202, [1.0, None, 1.0], 1)]
    rows += [(203, [1.0, math.nan, 1.0], 1), (204, [math.inf, 1.0, 1.0], 1), (250, [2.0], 1), (251, [1.0], 1), (252, [1.5], 2), (300, [], 1), (301, [], 1), (302, [], 2)]
    rows += [(-50, [0.0, 0.0, 0.0], 0), (-51, [0.0, 1.0, 0.0], 0)]
    check(spark, rows, row_block=11, anchor_block=2)


def test_scores_beyond_floating_point(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([1, -1]) * 2.0 ** r.choice([0, 10, 24, 27, 40, 60, 900]) * (1 + i / 1000) for _ in range(2)], r.randrange(2)) for i in range(100)]
    check(spark, rows, every=5, row_block=40)


def test_empty_table(spark):
    assert check(spark, []) == []


def test_one_hot_vector_and_label(spark):
    rows = [(i, [0.5, 0.5] if i % 3 else [0.4 + i / 1000, 0.3], 1 if i % 3 == 1 else 2) for i in range(400)]
    assert check(spark, rows, row_block=64, anchor_block=2)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-3, 8), st.integers(-5, 5), st.booleans()), max_size=60, unique_by=lambda x: x[:3]))
def test_stream_of_sorted_keys(rows):
    keys = sorted((H.pack(a, s, k), p) for a, s, k, p in rows)
    assert [H.unpack(k) for k, _ in keys] == sorted(((a, s, k) for a, s, k, _ in rows), key=lambda x: (x[0], -x[1], x[2]))
    exp = []
    for a in {x[0] for x in rows}:
        mine = sorted((-s, k, p) for b, s, k, p in rows if a == b)
        for p, pid, _ in [x for x in mine if x[2]][:5]:
            near = [(k, -n) for n, k, positive in mine if not positive and H.in_window(-p, -n)]
            exp += [(a, pid, i + 1, k, -p, n) for i, (k, n) in enumerate(near[:3])]
    assert sorted(H.stream_windows(iter(keys))) == sorted(exp)


def test_first_rows_keep_ties_in_order():
    r = np.random.default_rng(1)
    for n in (1, 3, 5):
        score = r.integers(-4, 4, 200)
        at = np.flatnonzero(r.random(200) < 0.7)
        assert H.first_rows(score, at, n).tolist() == sorted(at.tolist(), key=lambda i: (-score[i], i))[:n]
