"""Readers and sinks: rating coercion, tolerant JSON, CSV quoting / NA strings / BOM, shards."""

import json
import os
import tempfile

from starlens.sources import readers as RD
from starlens.sources import sinks as SK
from starlens.sources.schema import PROJECTED_REVIEW, schema_check


def _dir():
    return tempfile.mkdtemp(prefix="starlens-test-")


def test_rating_coercion_and_rejects(spark):
    d = _dir()
    lines = [
        json.dumps({"rating": 4, "text": "a"}),
        json.dumps({"rating": 4.0, "text": "b"}),
        json.dumps({"rating": "5", "text": "c"}),
        json.dumps({"rating": "x", "text": "d"}),
        json.dumps({"text": "e"}),
        '{"rating": 3, "text": "broken',
    ]
    with open(os.path.join(d, "Books_true.jsonl"), "w") as f:
        f.write("\n".join(lines) + "\n")
    good, rej = RD.read_reviews_tolerant(spark, d)
    proj = RD.review_projection(good)
    assert sorted(r["rating"] for r in proj.collect()) == [4, 4, 5]
    reasons = sorted(r["reject_reason"] for r in rej.collect())
    assert reasons == ["bad_rating", "bad_rating", "unparsable"]
    cat = RD.with_category(good).select("category").distinct().collect()
    assert [r[0] for r in cat] == ["Books"]


def test_csv_round_trip_edge_values(spark):
    rows = [(5, 2, 1, 1, 4, "P1", "", "U1", 1, 'say "hi", ok', "line1\nline2"),
            (3, 0, 0, 0, None, "NA", "None", "U2", 2, "  ", "")]
    df = spark.createDataFrame(rows, PROJECTED_REVIEW)
    d = _dir()
    SK.write_projection_csv(df, d)
    back = {r["user_id"]: r for r in RD.read_reviews_csv(spark, d).collect()}
    assert back["U1"]["title"] == 'say "hi", ok' and back["U1"]["text"] == "line1\nline2"
    assert back["U2"]["asin"] is None and back["U2"]["parent_asin"] is None and back["U2"]["text"] is None
    assert back["U2"]["title"] == "  "


def test_csv_bom_header(spark):
    d = _dir()
    with open(os.path.join(d, "x.csv"), "w", encoding="utf-8-sig") as f:
        f.write("rating,text_word_length,helpful_vote,verified_purchase,predict_stars,asin,parent_asin,user_id,timestamp,title,text\n")
        f.write("5,1,0,1,5,P,,U,1,t,x\n")
    r = RD.read_reviews_csv(spark, d).collect()[0]
    assert r["rating"] == 5 and r["asin"] == "P"


def test_schema_check(spark):
    df = spark.createDataFrame([(1, "a")], "rating int, extra string")
    st = {r["column"]: r["status"] for r in schema_check(df, PROJECTED_REVIEW).collect()}
    assert st["rating"] == "ok" and st["extra"] == "unexpected" and st["title"] == "missing"


def test_union_and_merge(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(2,)], "k int")
    u = RD.union_categories({"A": a, "B": b}).collect()
    assert sorted((r["k"], r["category"], r["v"]) for r in u) == [(1, "A", "x"), (2, "B", None)]
    assert RD.merge_shards(a, b).count() == 2
