import random

import numpy as np
import xxhash
from llm_cases import edge_docs, edge_rows, empty_docs, prose, unique_docs

from starlens.llm import simhash_balls as S
from starlens.llm.components import components


def brute(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, distance):
    """Root index of each fingerprint, by comparing all."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def check(rows, got, distance=4):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    fps = [brute(t) for _, t in rows]
    root = classes(fps, distance)
    least = {c: min((r[0] for r, x in zip(rows, root) if x == c and r[0] is not None), default=None) for c in root}
    exp = sorted((str(k), f, str(least[c])) for (k, _), f, c in zip(rows, fps, root))
    assert sorted((str(r.id), r.fp % (1 << 64), str(r.component_id)) for r in got) == exp


def test_fingerprint_and_classes_of_edge_rows(spark):
    check([(r[0], r[1]) for r in edge_rows()], S.near_groups(edge_docs(spark)).collect())


def test_chains_of_near_copies(spark):
    r = random.Random(2)
    texts = []
    for i in range(12):
        words = prose(250, i).split()
        for _ in range(8):
            words[r.randrange(len(words))] = "new"
            texts.append(" ".join(words))
    check(list(enumerate(texts)), S.near_groups(unique_docs(spark, texts)).collect())


def test_ball_links_at_each_distance_and_key_width(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(25)]
    fps = {0, (1 << 64) - 1, 1 << 63}
    for b in base:
        f = b
        for _ in range(6):
            for bit in r.sample(range(64), r.randint(1, 5)):
                f ^= 1 << bit
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for distance, groups in ((0, 3), (2, 5), (4, 6), (4, 9)):
        got = {r.id: r.root for r in components(S.ball_links(df, distance, groups)).collect()}
        root = classes(fps, distance)
        found = [got.get(f, f) for f in signed]
        assert {(a, b) for a, b in zip(root, found)} == {(root[i], found[root[i]]) for i in range(len(fps))}
        assert len(set(root)) == len(set(found))


def test_slices_of_a_key_give_the_same_links():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40)]))
    by = S.flips(2, 6)
    for key in range(8):
        a = S.key_links(fps, key, 6, by, 2)
        b = S.key_links(fps, key, 6, by, 2, at_once=500)
        assert [x.tolist() for x in a] == [x.tolist() for x in b]


def test_representatives(spark):
    docs = edge_docs(spark)
    out = S.keep_representatives(docs)
    assert out.columns == docs.columns
    want = {r.component_id for r in S.near_groups(docs).collect()}
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, want))


def test_empty_table(spark):
    assert S.near_groups(empty_docs(spark)).collect() == []
    assert S.keep_representatives(empty_docs(spark)).collect() == []
