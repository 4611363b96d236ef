"""The stages over small tables: each against its operator's brute force, and the whole run."""

from collections import Counter, defaultdict

from llm_cases import edge_docs, empty_docs, prose, unique_docs
from test_llm_exact import norm
from test_llm_simhash import brute, classes

import corpus_pipeline as C
from starlens.llm.quality_rules import RULES, Measures, verdict


def stages(spark, docs):
    out = [docs]
    for _, stage in C.STAGES:
        d = stage(spark, out[-1], "")
        out.append(spark.createDataFrame(d.collect(), d.schema))
    return out


def test_each_stage_takes_effect(spark):
    clean = [prose(90 + i, i) for i in range(12)]
    near = " ".join(prose(900, 77).split()[:-1] + ["other"])
    texts = clean + [clean[0].upper(), clean[1], "too short", "la " * 200, prose(900, 77), near, None, "", clean[2].replace(" ", "### ")]
    docs = unique_docs(spark, texts, lambda i: "ab"[i % 5 > 2])
    d0, d1, d2, d3, d4, d5 = stages(spark, docs)
    rows = [{(r.doc_id, r.text) for r in d.collect()} for d in (d0, d1, d2, d3, d4)]
    assert rows[1] == {(i, t) for i, t in rows[0] if verdict(Measures(t), list(RULES)) is None}
    keep = {}
    for i, t in sorted(rows[1]):
        keep[norm(t)] = (i, t)
    assert rows[2] == set(keep.values())
    by = sorted(rows[2])
    root = classes([brute(t) for _, t in by], 4)
    assert rows[3] == {by[c] for c in root}
    assert rows[4] <= rows[3]
    for d in (d1, d2, d3, d4):
        assert d.columns == docs.columns
    times = Counter(r.doc_id for r in d4.collect())
    assert max(times.values()) <= 3
    pieces = d5.collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == times
    fill = defaultdict(int)
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024


def test_edge_and_empty_tables(spark):
    for docs in (edge_docs(spark), empty_docs(spark)):
        for _, stage in C.STAGES:
            docs = stage(spark, docs, "")
            docs.collect()


def test_run_reads_documents(spark):
    out = C.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0
