import re
from itertools import permutations

from llm_cases import SCHEMA, edge_docs, edge_rows, empty_docs, prose

from starlens.llm import filter_audit as A

LABELS = "doc_id long, quality int, toxic int, TEXT string"


def brute(rows, labels):
    """Every order applied step by step; rows are (doc_id, text, part)."""

    def fails(k, t, f):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        if f == "A":
            return len(w) < 200
        if f == "B":
            return 100 * len(set(w)) < 50 * len(w)
        if f == "C":
            return 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)
        if f == "D":
            return bool(re.search(r"[#$%&*|]", t))
        return k is not None and any(j is not None and j < k and (u or "") == t for j, u, _ in rows)

    judged = [(p or "", {f for f in "ABCDE" if fails(k, t, f)}, {x for j, q, z in labels if j is not None and j == k for x in ("q" * (q == 1) + "t" * (z == 1))}) for k, t, p in rows]
    out = {}
    for part in {p for p, _, _ in judged}:
        mine = [(f, lab) for p, f, lab in judged if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                total[f] += len(gone)
                redundant = sum(f in x[0] for x in mine) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(x[0] == {f} for x in mine), sum("q" in x[1] for x in gone), sum("t" in x[1] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def check(spark, rows, labels):
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([(*x, "clash") for x in labels], LABELS)
    got = A.audit(A.document_masks(docs, marks)).collect()
    exp = brute([(r[0], r[1], r[2]) for r in rows], labels)
    assert len(got) == len(exp)
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == exp[r.part, r.filter_order, r.step]


def test_edge_rows_against_every_order(spark):
    rows = [(k, t, (p, None, "", "de")[i % 4], *rest) for i, (k, t, p, *rest) in enumerate(edge_rows())]
    check(spark, rows, [(0, 1, 0), (4, 1, 1), (4, 0, 0), (7, None, 1), (9, 1, None), (None, 1, 1), (1000, 1, 1)])


def test_every_mask(spark):
    rows = []
    for m in range(32):
        words = [f"w{i}" for i in range(250)]
        if m & 2:
            words = ["same"] * 230 + words[:20]
        if m & 1:
            words = words[-199:] if not m & 2 else ["same"] * 150 + words[230:240]
        text = " ".join(words) + f" mask {m}" * (not m & 16)
        text = text + " XXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXX" * (m >> 2 & 1)
        text = text + " #" * (m >> 3 & 1)
        rows += [(2 * m, text, "en", "s", 1, 7, "x", "y")]
        if m & 16:
            rows += [(2 * m + 1, text, ("en", "de")[m % 2], "s", 1, 7, "x", "y")]
    check(spark, rows, [(2 * m, m % 2, m % 3) for m in range(32)])


def test_repeated_rows_and_missing_ids_are_never_smaller(spark):
    t = prose(210, 4)
    check(spark, [(k, t, "en", "s", 1, 7, "x", "y") for k in (None, None, 5, 5, 9)], [(5, 1, 0), (9, 1, 1)])


def test_intervals_are_the_orders_that_remove_the_mask():
    orders = list(permutations(range(5)))
    for mask in range(32):
        got = {(step, rank) for step, a, b in A.intervals(mask) for rank in range(a, b)}
        exp = set()
        for rank, o in enumerate(orders):
            at = next((i for i, f in enumerate(o) if mask >> f & 1), None)
            if at is not None:
                exp.add((at, rank))
        assert got == exp


def test_empty_table(spark):
    labels = spark.createDataFrame([], LABELS)
    assert A.audit(A.document_masks(empty_docs(spark), labels)).collect() == []
    assert A.audit(A.document_masks(edge_docs(spark), labels)).count() == 600
