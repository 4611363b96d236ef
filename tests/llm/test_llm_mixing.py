import random

import pytest
from llm_cases import edge_docs, edge_rows, empty_docs, prose, unique_docs

from starlens.llm import mixing as M


def fill(sizes, weights=(5, 2, 1), most=3):
    """Water-filling by repeated clamping."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    free, left, target = set(names), float(sum(sizes.values())), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total >= most * sizes[s]}
        if not over:
            target.update({s: left * w[s] / total for s in free})
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_taken(spark, seed):
    r = random.Random(seed)
    names = ["b", "a", "ü", "Z", None, "zz", "c"]
    texts = [prose(r.choice([0, 1, 5, 40, 400]), i) for i in range(150)]
    pick = [r.choice(names[: 2 + 2 * seed + 1] * (1 if i % 3 else 1) + ["a"] * 4) for i in range(150)]
    docs = unique_docs(spark, texts, lambda i: pick[i])
    got = M.mix(docs, seed=seed).collect()
    size = [len(t.split()) for t in texts]
    sizes = {s: sum(n for n, p in zip(size, pick) if p == s) for s in set(pick)}
    target = fill(sizes)
    assert len(got) == 150
    for g in got:
        assert (g.size, g.source_size) == (size[g.id], sizes[pick[g.id]])
        assert g.target == pytest.approx(target[pick[g.id]])
        assert 0 <= g.taken <= 3 * g.size and g.taken == g.size * g.repeats
    for s in sizes:
        taken = sum(g.taken for g in got if pick[g.id] == s)
        assert abs(taken - target[s]) <= max(n for n, p in zip(size, pick) if p == s) / 2 + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, M.mix(docs, seed=seed).collect()))


def test_edge_rows_and_stage(spark):
    docs = edge_docs(spark)
    got = M.mix(docs).collect()
    assert len(got) == len(edge_rows()) and all(g.taken <= 3 * g.size for g in got)
    out = M.mix_documents(docs)
    assert out.columns == docs.columns
    out.collect()


def test_stage_repeats_rows(spark):
    docs = unique_docs(spark, [prose(30, i) for i in range(20)], lambda i: "a" if i < 2 else "b")
    want = {g.id: g.repeats for g in M.mix(docs).collect()}
    got = [r.doc_id for r in M.mix_documents(docs).collect()]
    assert {i: got.count(i) for i in want} == want and max(want.values()) == 3


def test_stage_takes_rows_that_repeat_an_id_each_by_its_source(spark):
    texts = [prose(20, i) for i in range(60)]
    docs = unique_docs(spark, texts, lambda i: "b").unionByName(unique_docs(spark, texts[:30], lambda i: "a"))
    want = {(g.id, g.source): g.repeats for g in M.mix(docs).collect()}
    got = [(r.doc_id, r.source) for r in M.mix_documents(docs).collect()]
    assert {k: got.count(k) for k in want} == want


def test_empty_table_and_no_words(spark):
    assert M.mix(empty_docs(spark)).collect() == []
    assert M.mix_documents(empty_docs(spark)).collect() == []
    assert {g.taken for g in M.mix(unique_docs(spark, [None, "", " "])).collect()} == {0}
