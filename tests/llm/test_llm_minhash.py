import math
import random

import numpy as np
from llm_cases import edge_docs, edge_rows, empty_docs, prose, unique_docs

from starlens.llm import minhash_bayes as M


def word_set(text, k=3):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def check(rows, got, percent=85, k=3):
    """Against all pairs; rows are (id, text)."""
    sets = [word_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    exp = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        exp.append((str(key), len(sets[i]), str(min(ids, default=None))))
    assert sorted((str(r.id), r.n, str(r.component_id)) for r in got) == sorted(exp)


def edited(words, r, changes):
    words = list(words)
    for _ in range(changes):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def test_edge_rows(spark):
    check([(r[0], r[1]) for r in edge_rows()], M.near_sets(edge_docs(spark)).collect())


def test_copies_at_all_similarities(spark):
    r = random.Random(5)
    texts = []
    for i in range(15):
        words = prose(200, i).split()
        texts += [edited(words, r, c) for c in (0, 0, 2, 4, 5, 6, 8, 12, 30)] + [prose(200, i).upper(), " ".join(words[: 160 + i])]
    r.shuffle(texts)
    check(list(enumerate(texts)), M.near_sets(unique_docs(spark, texts)).collect())


def test_large_buckets_in_blocks(spark):
    r = random.Random(6)
    words = prose(120, 1).split()
    # copies that are near the first text but mostly not near each other, and chains of small steps away from it
    texts = [edited(words, r, 3) for _ in range(150)] + [" ".join(words)]
    step = list(words)
    for _ in range(40):
        step = edited(step, r, 2).split()
        texts.append(" ".join(step))
    texts += ["one common passage that is long enough " * 3 + prose(30, 100 + i) for i in range(40)]
    r.shuffle(texts)
    for block in (4, 16, 512):
        check(list(enumerate(texts)), M.near_sets(unique_docs(spark, texts), block=block).collect())


def test_other_shingles_and_thresholds(spark):
    r = random.Random(7)
    texts = [edited(prose(100, i % 6).split(), r, r.randrange(12)) for i in range(60)] + ["a b", "a b", "a  B c", "a b c d e"]
    for k, percent in ((5, 80), (1, 60)):
        check(list(enumerate(texts)), M.near_sets(unique_docs(spark, texts), shingle=k, percent=percent).collect(), percent, k)


def test_posterior_bounds():
    """The bound after each batch is the first count whose beta posterior leaves the miss probability above the threshold."""
    for percent in (60, 85):
        for seen, m in zip(range(M.BATCH, M.HASHES + 1, M.BATCH), M.least_matches(percent)):

            def above(k):
                x = np.linspace(percent / 100, 1, 200_001)
                y = x**k * (1 - x) ** (seen - k)
                return (y.sum() - (y[0] + y[-1]) / 2) * (x[1] - x[0]) * math.comb(seen, k) * (seen + 1)

            assert above(m) >= M.MISS * 0.99
            assert m == 0 or above(m - 1) < M.MISS * 1.01


def test_forest_is_a_maximum_spanning_forest():
    r = np.random.default_rng(1)
    for n in (2, 5, 9):
        i, j = np.triu_indices(n, 1)
        stay = r.random(len(i)) < 0.5
        i, j = i[stay], j[stay]
        w = r.permutation(len(i))
        kruskal, label = set(), list(range(n))
        for k in np.argsort(-w):
            if label[i[k]] != label[j[k]]:
                old = label[j[k]]
                label = [label[i[k]] if x == old else x for x in label]
                kruskal.add((int(i[k]), int(j[k])))
        assert {tuple(sorted(e)) for e in M.forest(n, i, j, w)} == kruskal


def test_representatives_and_empty_table(spark):
    docs = edge_docs(spark)
    out = M.keep_representatives(docs)
    assert out.columns == docs.columns
    want = [r.id for r in M.near_sets(docs).collect() if r.id == r.component_id]
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, want))
    assert M.near_sets(empty_docs(spark)).collect() == []


def test_signatures_take_two_bytes_a_hash():
    hashes = M.WordHashes()
    sets = [M.shingle_set(prose(300, i), 3, hashes) for i in range(40)]
    sigs = np.stack([M.signature(s) for s in sets])
    assert len(sigs[0].tobytes()) == 2 * M.HASHES
    agree = [(sigs[i] == sigs[j]).mean() for i in range(40) for j in range(i) if not len(np.intersect1d(sets[i], sets[j]))]
    assert not agree or np.mean(agree) < 0.001
