import re
from collections import Counter

from llm_cases import edge_docs, edge_rows, empty_docs, prose, unique_docs

from starlens.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    seen = Counter(zip(w, w[1:], w[2:]))
    rep = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:i] for i, x in enumerate(lines)), len(rep)


def test_measures_match_brute_force(spark):
    got = Q.measure_rules(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows())
    exp = Counter((r[0], *brute(r[1])) for r in edge_rows())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == exp
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_verdicts(spark):
    clean = prose(200, 9)
    junk = [clean.replace(" ", "### "), " | ".join(clean.split()), clean.upper(), clean.replace(" ", "! "), "\n".join([prose(20, 3)] * 2 + ["x y z"]), "la " * 300, " ".join(["w" * 40 + str(i) for i in range(80)])]
    kept = {r.doc_id for r in Q.measure_rules(unique_docs(spark, [clean, *junk, clean + " 2 + 2 = 4. Really? Yes!"])).where("kept").collect()}
    assert kept == {0, len(junk) + 1}


def test_order_of_rules_changes_cost_only(spark):
    docs = edge_docs(spark)
    a = sorted(map(str, Q.apply_rules(docs).collect()))
    assert a == sorted(map(str, Q.apply_rules(docs, rules=Q.RULES[::-1]).collect()))
    assert a == sorted(map(str, Q.apply_rules(docs, sample_rows=1).collect()))
    assert Q.apply_rules(docs).columns == docs.columns


def test_plan_puts_rejections_per_cost_first(spark):
    rules = (Q.Rule("never", lambda m: False), Q.Rule("dear", lambda m: sum(range(20000)) < 0 or m.n_words < 50), Q.Rule("cheap", lambda m: m.n_words < 50))
    assert [x["name"] for x in Q.plan_rules(edge_docs(spark), rules=rules)] == ["cheap", "dear", "never"]


def test_empty_table(spark):
    assert Q.measure_rules(empty_docs(spark)).collect() == []
    assert Q.apply_rules(empty_docs(spark)).collect() == []
