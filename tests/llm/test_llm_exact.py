import hashlib
import random
from collections import Counter

from llm_cases import edge_docs, edge_rows, empty_docs, unique_docs
from pyspark.sql import functions as F

from starlens.llm import block_naming as B

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm(t):
    return (t or "").translate(LOW)


def check(rows, got):
    groups = {}
    for k, t in rows:
        groups.setdefault(norm(t), []).append(k)
    exp = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        for i in ids:
            exp[(i, keep, len(ids), sha)] += 1
    assert Counter((r.id, r.keep_id, r.group_size, r.text_sha256) for r in got) == exp
    assert Counter(r.text_sha256 for r in got if r.kept) == {hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups}
    assert all(r.id == r.keep_id for r in got if r.kept)


def test_edge_rows_at_several_block_sizes(spark):
    for block in (1, 4096):
        check([(r[0], r[1]) for r in edge_rows()] if block > 1 else [(r[0], r[1]) for r in edge_rows() if len(r[1] or "") < 400],
              B.exact_groups(edge_docs(spark) if block > 1 else edge_docs(spark).where("text is null or length(text) < 400"), block=block).collect())


def texts(n=60):
    r = random.Random(4)
    base = ["".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(12)]
    return [r.choice(base).upper() if r.random() < 0.3 else r.choice(base) for _ in range(n)]


def test_short_blocks_meet_over_many_levels(spark):
    t = texts()
    check(list(enumerate(t)), B.exact_groups(unique_docs(spark, t), block=2).collect())


def test_colliding_fingerprints_are_told_apart_by_content(spark):
    weak = lambda b: (F.length(b).cast("long"), F.lit(0).cast("long"))  # noqa: E731  every block of one length collides
    t = texts()
    check(list(enumerate(t)), B.exact_groups(unique_docs(spark, t), block=2, hashes=weak).collect())


def test_drop_copies_keeps_rows_and_columns(spark):
    docs = edge_docs(spark)
    out = B.drop_copies(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter(norm(r.text) for r in got) == {norm(r[1]): 1 for r in edge_rows()}
    t = texts()
    got = B.drop_copies(unique_docs(spark, t)).collect()
    assert {r.doc_id for r in got} == {max(i for i, x in enumerate(t) if norm(x) == n) for n in set(map(norm, t))}


def test_empty_table(spark):
    assert B.exact_groups(empty_docs(spark)).collect() == []
    assert B.drop_copies(empty_docs(spark)).collect() == []
