import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm_cases import edge_docs, edge_rows, empty_docs, prose, unique_docs

from starlens.llm import suffix_dedup as S


def brute(rows, length=100):
    """Rows in order -> (n_bytes, n_removed, n_spans, sha256 of the rest)."""
    seen, out = set(), []
    for _, t in rows:
        x = (t or "").encode()
        gone = bytearray(len(x))
        for s in range(len(x) - length + 1):
            w = x[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(x, gone) if not g)
        spans = sum(1 for i in range(len(x)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(rows, got):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    exp = Counter((r[0], *b) for r, b in zip(rows, brute(rows)))
    assert Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == exp


def passages():
    r = random.Random(3)
    p = prose(60, 40)
    texts = [prose(r.randint(0, 120), i) for i in range(30)]
    texts += [prose(r.randint(0, 20), 50 + i) + p[r.randint(0, 40) : len(p) - r.randint(0, 40)] + prose(10, 90 + i) for i in range(40)]
    return texts + ["a" * 2000, "ab" * 400 + p, "The " * 300, None, "", "é" * 200, texts[3], p, p, "x" * 99, "x" * 100, "x" * 100, p[:99], p[:100], p + p]


@pytest.mark.parametrize("options", [{}, {"hot": 2, "group_bytes": 3000}])
def test_passages_against_all_strings(spark, options):
    check(list(enumerate(passages())), S.suffix_dedup(unique_docs(spark, passages()), **options).collect())


def test_repeated_ids_and_null_ids(spark):
    # equal rows cannot be told apart and rows of one id have equal texts here, so any order of ties gives one result
    rows = [(r[0], r[1]) for r in edge_rows() if not (r[0] == 4 and r[1] != "Hello World")]
    docs = edge_docs(spark).where("not (doc_id <=> 4) or text = 'Hello World'")
    check(rows, S.suffix_dedup(docs).collect())


def test_anchors_cover_every_window_and_depend_on_content_only():
    r = np.random.default_rng(5)
    for x in (r.integers(0, 4, 3000), np.zeros(700), np.arange(900) % 7):
        buf = x.astype(np.uint8)
        valid = np.ones(len(buf), bool)
        valid[-99:] = False
        h, pos, lo, hi = S.anchors(buf, valid)
        assert sorted(s for a, b in zip(lo, hi) for s in range(a, b + 1)) == list(range(len(buf) - 99))
        assert ((lo <= pos) & (pos <= lo + 68) & (pos >= hi) & (pos <= hi + 68)).all()
        at = {}
        for p, a, b in zip(pos.tolist(), lo.tolist(), hi.tolist()):
            for s in range(a, b + 1):
                w = buf[s : s + 100].tobytes()
                assert at.setdefault(w, p - s) == p - s


def test_pieces_join_seamlessly(monkeypatch):
    buf = np.random.default_rng(6).integers(0, 3, 5000).astype(np.uint8)
    valid = np.ones(len(buf), bool)
    valid[-99:] = False
    whole = S.anchors(buf, valid)
    offsets = {s: p for p, a, b in zip(*map(np.ndarray.tolist, whole[1:])) for s in range(a, b + 1)}
    monkeypatch.setattr(S, "PIECE", 333)
    parts = S.anchors(buf, valid)
    assert {s: p for p, a, b in zip(*map(np.ndarray.tolist, parts[1:])) for s in range(a, b + 1)} == offsets


def test_suffix_sort_orders_and_measures_extensions(monkeypatch):
    r = np.random.default_rng(7)
    text = r.integers(0, 2, (300, 12)).astype(np.uint8)
    group = np.sort(r.integers(0, 9, 300))

    def check_sort():
        order, ext = S.suffix_sort(group, text)
        assert sorted(order.tolist()) == list(range(300))
        key = [(group[i], text[i].tobytes()) for i in order]
        assert key == sorted(key)
        for k in range(1, 300):
            i, j = order[k - 1], order[k]
            same = next((d for d in range(12) if text[i, d] != text[j, d]), 12)
            assert ext[k] == (same if group[i] == group[j] else -1)

    check_sort()
    monkeypatch.setattr(S, "BYTE", np.ones(256, np.uint64))  # every comparison of hashes is misled
    check_sort()


def test_colliding_hashes_are_verified():
    data = np.array([[1, 2], [3, 4], [1, 2]], np.uint8)
    zero = np.zeros(3, np.int64)
    assert S.firsts(np.zeros(3, np.uint64), zero, zero, data).tolist() == [True, True, False]


def test_empty_table(spark):
    assert S.suffix_dedup(empty_docs(spark)).collect() == []
