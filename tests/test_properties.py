"""Properties from the test strategy: sums, ranges, stream = batch, idempotent re-runs, model invariants."""

import math

from pyspark.sql import functions as F

from __spark_entry__ import queries
from conftest import SF_SMALL
from starlens.operators import models as M
from starlens.sources.tables import review_texts, table


def q(spark, name):
    return queries()[name](spark, SF_SMALL)


def test_crosstab_rows_sum_to_100(spark):
    for name in ("topic_length_crosstab", "topic_verified_crosstab"):
        df = q(spark, name)
        cols = [c for c in df.columns if c.endswith("_pct")]
        for r in df.collect():
            assert math.isclose(sum(r[c] for c in cols), 100.0, abs_tol=1e-4)


def test_topic_shares_sum_to_one(spark):
    assert math.isclose(sum(r["share"] for r in q(spark, "topic_counts").collect()), 1.0, abs_tol=1e-5)


def test_sentiment_range(spark):
    lo, hi = q(spark, "lexicon_sentiment").agg(F.min("sentiment"), F.max("sentiment")).first()
    assert -1.0 <= lo <= hi <= 1.0


def test_stream_equals_batch(spark):
    got = sorted(tuple(r) for r in q(spark, "stream_ingest").collect())
    d = review_texts(spark, SF_SMALL).select(
        "review_id", "category", F.col("rating").cast("string").alias("rating"), "predict_stars", "verified_purchase"
    )
    assert got == sorted(tuple(r) for r in d.collect())


def test_resume_adds_each_row_once(spark):
    n = review_texts(spark, SF_SMALL).count()
    rows = q(spark, "stream_resume").collect()
    assert sum(r["n_rows"] for r in rows) == n
    assert all(r["n_rows"] == r["n_ids"] for r in rows)


def test_stream_metrics_cover_all_rows(spark):
    n = review_texts(spark, SF_SMALL).count()
    assert q(spark, "stream_metrics").agg(F.sum("num_input_rows")).first()[0] == n


def test_each_vector_at_nearest_centroid(spark):
    e = table(spark, SF_SMALL, "embeddings")
    cents = {r["label"]: r["centroid"] for r in M.mean_vectors(e, "label", "embedding").collect()}
    for r in q(spark, "nearest_centroid").join(e.select("vec_id", "embedding"), "vec_id").collect():
        d = {k: sum((float(a) - b) ** 2 for a, b in zip(r["embedding"], c)) for k, c in cents.items()}
        assert d[r["cluster"]] <= min(d.values()) + 1e-9


def test_importances_sum_to_one(spark):
    for r in q(spark, "feature_importance").groupBy("target").agg(F.sum("importance").alias("s")).collect():
        assert math.isclose(r["s"], 1.0, abs_tol=1e-4)


def test_kmeans_apply_matches_fit(spark):
    a = {r["review_id"]: r["topic"] for r in q(spark, "kmeans_topics").collect()}
    b = {r["review_id"]: r["topic"] for r in q(spark, "kmeans_apply").collect()}
    assert b and all(a[k] == v for k, v in b.items())


def test_split_sizes(spark):
    rows = q(spark, "stratified_split").groupBy("category", "verified_purchase", "split").count().collect()
    per = {}
    for r in rows:
        per.setdefault((r[0], r[1]), {})[r["split"]] = r["count"]
    for v in per.values():
        assert v.get("train", 0) == math.floor(0.8 * (v.get("train", 0) + v.get("test", 0)))
