"""MLlib queries.  Fitted models have no SQL oracle of their own; the ``_check`` queries hold them to exact properties."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starlens.functions.text import clean_text
from starlens.operators import models as M
from starlens.operators import products as P
from starlens.operators import rollups as R
from starlens.operators import sampling as S
from starlens.operators import vocab as V
from starlens.operators.prepare import prepare_texts
from starlens.operators.vocab import STOP_WORDS_EN
from starlens.plans.analysis import RQ3_CTES
from starlens.plans.fixtures_sql import REVIEW_TEXTS, REVIEWS, TEXTS_PREPARED, with_ctes
from starlens.plans.products import NEG_HEAD, SENTIMENT_CTES, _sentiment, negative_scores, product_stats_df
from starlens.plans.registry import register, side_by_side
from starlens.session import materialise
from starlens.sources.tables import review_texts, reviews, table

SAMPLE_N = 50_000


def _rq2(spark, sf):
    return prepare_texts(review_texts(spark, sf))


@register("kmeans_topics")
def kmeans_topics(spark, sf):
    """ML-1: TF-IDF (1,000 terms) → KMeans k=5 seed 42 → canonical topic per review."""
    d = _rq2(spark, sf)
    _, labels = M.topic_model(d, "review_text", "review_id", STOP_WORDS_EN)
    return labels


@register("kmeans_apply")
def kmeans_apply(spark, sf):
    """ML-2: the fitted pipeline applied to a seeded sample of 50,000 reviews."""
    d = _rq2(spark, sf)
    model = M.fit_topics(d, "review_text", STOP_WORDS_EN)
    sample = S.sample_n(d, SAMPLE_N, ["review_id"])
    return M.apply_topics(model, sample, "review_id")


def _lda(spark, sf, key=None):
    d = review_texts(spark, sf).withColumn("clean_text", clean_text("text"))
    return M.fit_lda(d, "clean_text", STOP_WORDS_EN, key=key)


@register("lda_topics")
def lda_topics(spark, sf):
    """ML-3: LDA k=5 seed 42 on cleaned text; dominant topic per review."""
    _, dominant = _lda(spark, sf, "review_id")
    return dominant


@register("lda_topic_words")
def lda_topic_words(spark, sf):
    """ML-4: ten top words per LDA topic."""
    model, _ = _lda(spark, sf)
    return M.lda_words(model, 10)


@register("embedding_clusters")
def embedding_clusters(spark, sf):
    """ML-5: KMeans k=5 on the embedding vectors; cluster sizes."""
    e = table(spark, sf, "embeddings")
    lab = M.embedding_clusters(e, "embedding", "vec_id")
    return lab.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_vectors"))


def _split_stats(spark, sf):
    """Per-product features with their seeded 80/20 split, written once (shared checkpoint folder).

    The split reads the statistics twice and every forest reads its training rows several times (split
    candidates, then the bagged tree input); without the written table each of those reads would score the
    review text again.  The table has one row per product.
    """
    stats = materialise(product_stats_df(spark, sf), "product-stats")
    split = materialise(S.train_test(stats, ["asin"], 0.2), "product-split")
    return split.filter(F.col("split") == "train"), split.filter(F.col("split") == "test")


def _forest(train, target):
    return M.fit_forest(train, target, P.FEATURES)


def _metrics(spark, sf, target):
    train, test = _split_stats(spark, sf)
    pred = _forest(train, target).transform(test)
    return M.regression_metrics(pred, target, "_pred").select(F.lit(target).alias("target"), "*")


@register("rf_sales")
def rf_sales(spark, sf):
    """ML-7 + ML-8: forest on the 7 product features → sales proxy; R² and RMSE on the 20 % test split."""
    return _metrics(spark, sf, "sales_proxy")


@register("rf_reputation")
def rf_reputation(spark, sf):
    """ML-7 + ML-8: forest → reputation risk; R² and RMSE on the test split."""
    return _metrics(spark, sf, "reputation_risk")


@register("feature_importance")
def feature_importance(spark, sf):
    """ML-9: feature importances of both forests, sorted; the top two are the drivers."""
    train, _ = _split_stats(spark, sf)
    out = None
    for target in ("sales_proxy", "reputation_risk"):
        model = _forest(train, target)
        imp = M.feature_importance(model, P.FEATURES).select(F.lit(target).alias("target"), "*")
        out = imp if out is None else out.unionByName(imp)
    return out


# ---------------------------------------------------------------- fitted models, checked by exact properties


def _labelled(labels, key, low=0, high=4):
    """(n_labels, n_keys, labels_in_range) of a label table."""
    return labels.agg(
        F.count(F.lit(1)).alias("n_labels"), F.count_distinct(key).alias("n_keys"), F.min(F.col(labels.columns[-1]).between(low, high)).alias("labels_in_range")
    )


_N_TEXTS = with_ctes(REVIEW_TEXTS, TEXTS_PREPARED)


@register(
    "kmeans_topics_check",
    _N_TEXTS + " SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_violations, count(*) AS n_labels, count(DISTINCT review_id) AS n_keys, true AS labels_in_range FROM texts_prepared",
)
def kmeans_topics_check(spark, sf):
    """ML-1: every review is in the cluster of its nearest centre, once, with a label in range."""
    d = _rq2(spark, sf)
    model, labels = M.topic_model(d, "review_text", "review_id", STOP_WORDS_EN)
    near = M.centre_violations(model.transform(d).select("_x", "_cluster"), model.stages[-1].clusterCenters(), "_x")
    return side_by_side(near, _labelled(labels, "review_id"))


APPLY_SMALL = 200


@register(
    "kmeans_apply_check",
    _N_TEXTS
    + f""" SELECT least(count(*), {APPLY_SMALL}) AS n_rows, CAST(0 AS BIGINT) AS n_violations, least(count(*), {APPLY_SMALL}) AS n_labels,
       least(count(*), {APPLY_SMALL}) AS n_keys, true AS labels_in_range FROM texts_prepared""",
)
def kmeans_apply_check(spark, sf):
    """ML-2 with a sample that binds: 200 seeded reviews, each in the cluster of its nearest fitted centre."""
    d = _rq2(spark, sf)
    model = M.fit_topics(d, "review_text", STOP_WORDS_EN)
    sample = S.sample_n(d, APPLY_SMALL, ["review_id"])
    near = M.centre_violations(model.transform(sample).select("_x", "_cluster"), model.stages[-1].clusterCenters(), "_x")
    return side_by_side(near, _labelled(M.apply_topics(model, sample, "review_id"), "review_id"))


@register(
    "lda_check",
    RQ3_CTES
    + """ SELECT (SELECT count(*) FROM review_texts) AS n_labels, (SELECT count(DISTINCT review_id) FROM review_texts) AS n_keys, true AS labels_in_range,
       CAST(5 AS BIGINT) AS n_topics, CAST(50 AS BIGINT) AS n_words, CAST(0 AS BIGINT) AS n_unordered, (SELECT count(*) FROM vocab) AS n_terms""",
)
def lda_check(spark, sf):
    """ML-3 / ML-4: a topic for every review, ten words a topic by falling weight, and every term within the frequency bounds in the vocabulary."""
    model, labels = _lda(spark, sf, "review_id")
    w = M.lda_words(model, 10)
    falls = F.col("weight") > F.lag("weight").over(W.partitionBy("topic").orderBy("word_rank"))
    words = w.withColumn("up", falls).agg(F.count_distinct("topic").alias("n_topics"), F.count(F.lit(1)).alias("n_words"), F.count_if("up").alias("n_unordered"))
    n_terms = spark.createDataFrame([(len(model.stages[-2].vocabulary),)], "n_terms long")
    return side_by_side(_labelled(labels, "review_id"), words, n_terms)


@register(
    "embedding_clusters_check",
    "SELECT count(*) AS n_labels, count(DISTINCT vec_id) AS n_keys, true AS labels_in_range, true AS sizes_fall FROM embeddings",
)
def embedding_clusters_check(spark, sf):
    """ML-5: every vector has one label in range, and labels are numbered by falling size."""
    lab = M.embedding_clusters(table(spark, sf, "embeddings"), "embedding", "vec_id")
    sizes = lab.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    grows = F.col("n") > F.lag("n").over(W.orderBy("cluster"))  # at most five rows
    return side_by_side(_labelled(lab, "vec_id"), sizes.withColumn("up", grows).agg((F.count_if("up") == 0).alias("sizes_fall")))


# Products of the numeric reviews: thousands of them, with features that stand in for the text ones
def _numeric_products(spark, sf):
    r = reviews(spark, sf)
    sentiment = (F.col("predict_stars") - 3) / 2.0
    features = r.select(
        "asin", "rating", F.coalesce(sentiment, F.lit(0.0)).alias("sentiment"), F.length("title").alias("text_length"), (F.col("helpful_vote") % 3).alias("image_count"),
        F.exp(-F.datediff(F.lit("1999-01-01"), F.col("review_time")) / 3650.0).alias("time_weight"), "helpful_vote", F.col("verified_purchase").cast("int").alias("verified_purchase"),
        F.lit(0).alias("topic"),
    )
    stats = materialise(P.product_stats(features), "numeric-products")
    split = materialise(S.train_test(stats, ["asin"], 0.2), "numeric-split")
    return split.filter(F.col("split") == "train"), split.filter(F.col("split") == "test")


@register(
    "rf_check",
    with_ctes(REVIEWS)
    + """, n AS (SELECT count(DISTINCT asin) AS n FROM reviews), t AS (SELECT unnest(['sales_proxy', 'reputation_risk']) AS target)
  SELECT target, n - CAST(ceil(n * 0.2) AS BIGINT) AS n_train, CAST(ceil(n * 0.2) AS BIGINT) AS n_test, CAST(7 AS BIGINT) AS n_features, 1.0 AS importance_sum, true AS beats_mean FROM n, t""",
)
def rf_check(spark, sf):
    """ML-7 / ML-8 / ML-9 over every product of the numeric reviews: split sizes, importances that add up to 1, and a forest that fits its training rows better than their mean."""
    train, test = _numeric_products(spark, sf)
    out = None
    for target in ("sales_proxy", "reputation_risk"):
        model = M.fit_forest(train, target, P.FEATURES)
        imp = M.feature_importance(model, P.FEATURES).agg(F.count(F.lit(1)).alias("n_features"), F.round(F.sum("importance"), 3).alias("importance_sum"))
        n_test = M.regression_metrics(model.transform(test), target, "_pred").select(F.col("n").alias("n_test"))
        fit = M.regression_metrics(model.transform(train), target, "_pred").select(F.col("n").alias("n_train"), (F.col("r2") > 0).alias("beats_mean"))
        one = side_by_side(fit, n_test, imp).select(F.lit(target).alias("target"), "n_train", "n_test", "n_features", "importance_sum", "beats_mean")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- chains


def _head_sql(limit: int) -> str:
    return SENTIMENT_CTES + f""", head AS (SELECT review_id FROM scored WHERE sentiment < 0 ORDER BY review_id LIMIT {limit})
  SELECT count(*) AS n_members, count(*) AS n_keys, true AS labels_in_range, true AS keywords_ranked, CAST(0 AS BIGINT) AS n_strays
  FROM head JOIN embeddings ON vec_id = review_id"""


SMALL_HEAD = 80  # binds at every size


@register("negative_clusters_head", _head_sql(SMALL_HEAD))
def negative_clusters_head(spark, sf):
    """The chain of ``negative_clusters`` with a head that binds."""
    return _negative_clusters(spark, sf, SMALL_HEAD)


@register("negative_clusters", _head_sql(NEG_HEAD))
def negative_clusters(spark, sf):
    """Negative reviews → the first 10,000 by key → their embeddings → clusters → sizes and ten keywords a cluster, as one chain."""
    return _negative_clusters(spark, sf, NEG_HEAD)


def _negative_clusters(spark, sf, limit):
    head = S.head_n(negative_scores(spark, sf).select("review_id"), limit, "review_id")
    e = table(spark, sf, "embeddings")
    vectors = materialise(e.join(head, e.vec_id == head.review_id).select("review_id", "embedding"), "negative-vectors")
    lab = M.embedding_clusters(vectors, "embedding", "review_id")
    # only the members' texts are cleaned, and once
    members = review_texts(spark, sf).select("review_id", "text").join(lab, "review_id")
    d = V.counted(members.withColumn("clean_text", clean_text("text")), "clean_text", ["cluster"])
    stats, n = V.corpus_terms(d, "clean_text")
    vocab = V.term_stats(stats, n, 2, 0.95, None)
    kw = V.cluster_keywords(V.count_matrix(V.doc_terms(d, "clean_text", ["cluster"]), vocab), "cluster")
    shape = kw.groupBy("cluster").agg(F.max("term_rank").alias("top"), F.count(F.lit(1)).alias("n"))
    ranked = shape.agg(F.coalesce(F.min((F.col("top") <= 10) & (F.col("top") == F.col("n"))), F.lit(False)).alias("keywords_ranked"))
    strays = kw.join(lab.select("cluster").distinct(), "cluster", "left_anti").agg(F.count(F.lit(1)).alias("n_strays"))
    return side_by_side(_labelled(lab, "review_id").withColumnRenamed("n_labels", "n_members"), ranked, strays)


@register(
    "fitted_topic_reports",
    _N_TEXTS
    + """ SELECT count(*) AS n_reviews, 1.0 AS share, count(rating_diff) AS n_diffs, count(DISTINCT review_id) AS n_keys, true AS in_range, true AS pct_whole
  FROM texts_prepared""",
)
def fitted_topic_reports(spark, sf):
    """ML-1 fed into AGG-7, AGG-15 and AGG-17: the topic reports over fitted topics account for every review."""
    d = materialise(_rq2(spark, sf).drop("topic"), "topic-texts")
    _, labels = M.topic_model(d, "review_text", "review_id", STOP_WORDS_EN)
    t = materialise(d.join(labels, "review_id"), "topic-labelled")
    counts = R.topic_counts(t).agg(F.sum("n_reviews").alias("n_reviews"), F.round(F.sum("share"), 4).alias("share"))
    diffs = R.topic_rating_diff(t).agg(F.sum("review_count").alias("n_diffs"))
    cross = R.crosstab_pct(t, "topic", "verified_purchase", (False, True), ("not_verified_pct", "verified_pct"))
    whole = cross.agg(F.min(F.abs(F.col("not_verified_pct") + F.col("verified_pct") - 100) < 0.001).alias("pct_whole"))
    keys = labels.agg(F.count_distinct("review_id").alias("n_keys"), F.min(F.col("topic").between(0, 4)).alias("in_range"))
    return side_by_side(counts, diffs, keys, whole)
