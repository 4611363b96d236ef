"""Models: nearest centroid, regression metrics, k-means / LDA topics, forests and their importances.

The core of every fit is an MLlib estimator (distributed over executors); relational glue stays in
DataFrame expressions.  A centroid table is bounded in bytes (checked) before it is broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlens.session import materialise

MAX_CENTROID_BYTES = 64 << 20
DIGITS = 6


def mean_vectors(df: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, centroid array<double>): element-wise mean per group (posexplode + partial aggregation)."""
    ex = df.select(group, F.posexplode(vec).alias("_i", "_v"))
    m = ex.groupBy(group, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    return m.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_s")).select(
        group, F.col("_s._m").alias("centroid")
    )


def _closest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and squared distance of the closest centre of each row; the first one wins a tie."""
    best, dist = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for i, center in enumerate(centers):
        d = ((x - center) ** 2).sum(axis=1)
        nearer = d < dist
        best[nearer], dist[nearer] = i, d[nearer]
    return best, dist


def nearest_centroid(df: DataFrame, centroids: DataFrame, vec: str, label: str, out: str = "cluster", most_bytes: int = MAX_CENTROID_BYTES) -> DataFrame:
    """Assign each vector to its closest centroid (squared Euclidean; ties → smallest label).

    Up to ``most_bytes`` (k × dimension × 8 bytes, checked before they are fetched) the centroids are one broadcast matrix, compared with a batch of
    vectors at a time.  More of them stay distributed, in blocks of that size; see ``_nearest_in_blocks``.
    """
    shape = centroids.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.max(F.size("centroid")), F.lit(0)).alias("d")).first()
    kind = centroids.schema[label].dataType
    if not shape["k"]:
        return df.withColumn(out, F.lit(None).cast(kind))
    size = 8 * shape["k"] * shape["d"]
    if size > most_bytes:
        return _nearest_in_blocks(df, centroids, vec, label, out, -(-size // most_bytes))
    rows = sorted(centroids.select(label, "centroid").collect(), key=lambda r: r[0])
    held = df.sparkSession.sparkContext.broadcast((np.array([r[1] for r in rows], float), pd.Series([r[0] for r in rows])))

    @F.pandas_udf(kind)
    def closest(vectors: pd.Series) -> pd.Series:
        centers, labels = held.value
        x = np.stack(vectors.to_list()).astype(float) if len(vectors) else np.zeros((0, centers.shape[1]))
        return labels.iloc[_closest(x, centers)[0]].reset_index(drop=True)

    return df.withColumn(out, closest(F.col(vec)))


def _nearest_in_blocks(df: DataFrame, centroids: DataFrame, vec: str, label: str, out: str, blocks: int) -> DataFrame:
    """``nearest_centroid`` for any number of centroids: every block of rows meets every block of centroids in a task of its own, which
    sends on one (distance, label) for each row; a row's smallest one wins.  Neither side is gathered or broadcast."""
    rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "centroid-rows")
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = centroids.schema[label].dataType
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.select("_row", F.col(vec).cast("array<double>").alias("x"), F.pmod(F.xxhash64("_row"), F.lit(parts)).alias("rb")).withColumn("cb", every(blocks))
    right = centroids.select(F.col(label).alias("l"), F.col("centroid").cast("array<double>").alias("c"), F.pmod(F.xxhash64(F.col(label)), F.lit(blocks)).alias("cb")).withColumn("rb", every(parts))

    def body(x: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(c):
            return pd.DataFrame({"_row": [], "d": [], "l": []})
        c = c.sort_values("l")
        best, dist = _closest(np.stack(x["x"].to_list()), np.stack(c["c"].to_list()))
        return pd.DataFrame({"_row": x["_row"].to_numpy(), "d": dist, "l": c["l"].to_numpy()[best]})

    schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("l", kind)])
    found = left.groupBy("rb", "cb").cogroup(right.groupBy("rb", "cb")).applyInPandas(body, schema)
    best = found.groupBy("_row").agg(F.min(F.struct("d", "l")).alias("m")).select("_row", F.col("m.l").alias(out))
    return rows.join(best, "_row", "left").drop("_row")


def regression_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(n, r2, rmse) over rows where both sides are present — one pass of sums."""
    d = df.filter(F.col(label).isNotNull() & F.col(pred).isNotNull())
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    g = d.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((y - p) * (y - p)).alias("_sse"),
        F.sum(y).alias("_sy"),
        F.sum(y * y).alias("_syy"),
    )
    sst = F.col("_syy") - F.col("_sy") * F.col("_sy") / F.col("n")
    return g.select(
        "n",
        F.round(1 - F.try_divide(F.col("_sse"), sst), DIGITS).alias("r2"),  # constant labels → NULL
        F.round(F.sqrt(F.col("_sse") / F.col("n")), DIGITS).alias("rmse"),
    )


# ---------------------------------------------------------------- text topic models (MLlib)

def _argmax(vec: Column) -> Column:
    from pyspark.ml.functions import vector_to_array

    arr = vector_to_array(vec)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def canonical_labels(df: DataFrame, pred: str, key: str, out: str = "topic") -> DataFrame:
    """Relabel arbitrary cluster ids: by size descending, then by smallest member key (k rows, broadcast)."""
    from pyspark.sql import Window

    sizes = df.groupBy(pred).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_k"))
    order = sizes.withColumn(out, (F.row_number().over(Window.orderBy(F.desc("_n"), F.asc("_k"))) - 1).cast("int"))
    return df.join(F.broadcast(order.select(pred, out)), pred).drop(pred)


def tokenise_stages(text: str, stop):
    """Tokenise (2+ word chars, lower-cased), drop stop words: ``text`` → ``_words``."""
    from pyspark.ml.feature import RegexTokenizer, StopWordsRemover

    from starlens.functions.text import TOKEN

    return [
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=TOKEN, gaps=False, toLowercase=True, minTokenLength=2),
        StopWordsRemover(inputCol="_tok", outputCol="_words", stopWords=list(stop)),
    ]


def count_stage(min_df=10, max_df=0.95, vocab_size=1000):
    """Term counts ``_words`` → ``_tf`` with document-frequency bounds and a top-N (by corpus count) vocabulary."""
    from pyspark.ml.feature import CountVectorizer

    return CountVectorizer(inputCol="_words", outputCol="_tf", minDF=float(min_df), maxDF=float(max_df), vocabSize=vocab_size)


def tfidf_pipeline(text: str, stop, min_df=10, max_df=0.95, vocab_size=1000):
    """Tokenise, drop stop words, count (df bounds, top-N by corpus count)."""
    return [*tokenise_stages(text, stop), count_stage(min_df, max_df, vocab_size)]


def _tokenised(df: DataFrame, text: str, stop, keep):
    """(tokeniser PipelineModel, ``keep`` + ``_words`` persisted once).

    Every later step (vocabulary fit, IDF fit, each model iteration, the predictions) reads the persisted
    tokens, so the regex tokeniser runs over the corpus a single time.  MEMORY_AND_DISK spills rather than
    fails, and lost blocks are recomputed from lineage.
    """
    from pyspark.ml import PipelineModel
    from pyspark.storagelevel import StorageLevel

    tok = PipelineModel(stages=tokenise_stages(text, stop))
    return tok, tok.transform(df).select(*keep, "_words").persist(StorageLevel.MEMORY_AND_DISK)


def _fit_kmeans(words: DataFrame, keep, k, seed, min_df, max_df, vocab_size):
    """Vocabulary, smooth-idf weights (idf + 1, as in the reference's vectoriser), L2 rows and KMeans(k) with
    k-means|| on persisted tokens.  Returns the fitted stages and the (keep + ``_x``) feature rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    cv = count_stage(min_df, max_df, vocab_size).fit(words)
    tf = cv.transform(words)
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(tf).idf.toArray()
    scale = ElementwiseProduct(inputCol="_tf", outputCol="_w", scalingVec=Vectors.dense(idf + 1.0))
    norm = Normalizer(inputCol="_w", outputCol="_x", p=2.0)
    feats = norm.transform(scale.transform(tf)).select(*keep, "_x")
    # KMeans persists its own vector input (unpersisted here), so the iterations re-read vectors, not text
    km = KMeans(featuresCol="_x", predictionCol="_cluster", k=k, seed=seed, maxIter=300, tol=1e-4).fit(feats)
    return [cv, scale, norm, km], feats


def topic_model(df: DataFrame, text: str, key: str, stop, k: int = 5, seed: int = 42, min_df=10, max_df=0.95,
                vocab_size=1000, out: str = "topic"):
    """ML-1: TF-IDF → KMeans topics.  Returns ``(model, labels)``.

    ``model`` is the fitted PipelineModel (output column ``_cluster``; apply it to new rows with
    ``apply_topics``); ``labels`` is (key, topic) for every input row, canonically labelled.  The corpus is
    tokenised once; the predictions are written once (shared checkpoint folder) while the tokens are still
    persisted, because relabelling reads them twice.
    """
    from pyspark.ml import PipelineModel

    from starlens.session import materialise

    tok, words = _tokenised(df, text, stop, [key])
    try:
        stages, feats = _fit_kmeans(words, [key], k, seed, min_df, max_df, vocab_size)
        preds = materialise(stages[-1].transform(feats).select(key, "_cluster"), "topic-predictions")
    finally:
        words.unpersist()
    return PipelineModel(stages=[*tok.stages, *stages]), canonical_labels(preds, "_cluster", key, out)


def fit_topics(df: DataFrame, text: str, stop, k: int = 5, seed: int = 42, min_df=10, max_df=0.95, vocab_size=1000):
    """ML-1 model only (see ``topic_model``); the fitted PipelineModel's output column is ``_cluster``."""
    from pyspark.ml import PipelineModel

    tok, words = _tokenised(df, text, stop, [])
    try:
        stages, _ = _fit_kmeans(words, [], k, seed, min_df, max_df, vocab_size)
    finally:
        words.unpersist()
    return PipelineModel(stages=[*tok.stages, *stages])


def apply_topics(model, df: DataFrame, key: str, out: str = "topic") -> DataFrame:
    """ML-2: apply a fitted topic pipeline; labels made canonical.

    Predictions are written once (shared checkpoint folder) because relabelling reads them twice.
    """
    from starlens.session import materialise

    preds = materialise(model.transform(df).select(key, "_cluster"), "topic-predictions")
    return canonical_labels(preds, "_cluster", key, out)


def fit_lda(df: DataFrame, text: str, stop, k: int = 5, seed: int = 42, min_df=2, max_df=0.95, max_iter: int = 10,
            key: str | None = None):
    """ML-3: counts (2 ≤ df ≤ 95 %) → online LDA on the full corpus each iteration.

    Returns ``(model, dominant)``.  With ``key``, ``dominant`` is (key, topic) for every input row, written
    once while the tokens are still persisted; without it, ``dominant`` is None.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.clustering import LDA
    from pyspark.storagelevel import StorageLevel

    from starlens.session import materialise

    tok, words = _tokenised(df, text, stop, [key] if key else [])
    dominant = None
    try:
        # every term within the bounds: the vocabulary's size is counted first
        df_ = words.select(F.explode(F.array_distinct("_words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        n_terms = df_.where(F.col("n") >= min_df).count()
        cv = count_stage(min_df, max_df, max(1, n_terms)).fit(words)
        # every task of the fit has a matrix of topics x terms of its own, and every task of the transform one to read: as many tasks as cores, not as
        # the input has partitions, or the work would grow with partitions times terms
        tf = cv.transform(words).coalesce(words.sparkSession.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            lda = LDA(featuresCol="_tf", k=k, seed=seed, optimizer="online", subsamplingRate=1.0, maxIter=max_iter,
                      topicDistributionCol="_dist").fit(tf)
            if key:
                topic = _argmax(F.col("_dist")).alias("topic")
                dominant = materialise(lda.transform(tf).select(key, topic), "lda-topics")
        finally:
            tf.unpersist()
    finally:
        words.unpersist()
    return PipelineModel(stages=[*tok.stages, cv, lda]), dominant


def lda_words(model, k: int = 10) -> DataFrame:
    """ML-4: (topic, word_rank, term, weight) — top k words per topic."""
    cv, lda = model.stages[-2], model.stages[-1]
    rows = lda.describeTopics(k).collect()  # k words of each topic
    named = [
        (int(r["topic"]), i, cv.vocabulary[t], float(w)) for r in rows for i, (t, w) in enumerate(zip(r["termIndices"], r["termWeights"]))
    ]
    out = lda_session(lda).createDataFrame(named, "topic int, word_rank int, term string, weight double")
    return out.withColumn("weight", F.round("weight", DIGITS))


def lda_session(model):
    return model.describeTopics(1).sparkSession


def embedding_clusters(df: DataFrame, vec: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """ML-5: KMeans on embedding arrays; (key, cluster) with canonical labels."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from pyspark.storagelevel import StorageLevel

    from starlens.session import materialise

    d = df.select(key, array_to_vector(F.col(vec)).alias("_x")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        km = KMeans(featuresCol="_x", predictionCol="_cluster", k=k, seed=seed, maxIter=300, tol=1e-4).fit(d)
        # written once: relabelling reads the predictions twice, and the vectors can then be released
        preds = materialise(km.transform(d).select(key, "_cluster"), "embedding-predictions")
    finally:
        d.unpersist()
    return canonical_labels(preds, "_cluster", key, "cluster")


def centre_violations(predicted: DataFrame, centers, vec: str, cluster: str = "_cluster", slack: float = 1e-9) -> DataFrame:
    """(n_rows, n_violations): rows whose cluster's centre is not the nearest one, distances taken anew from ``centers``."""
    from pyspark.ml.functions import vector_to_array

    matrix = predicted.sparkSession.sparkContext.broadcast(np.array(centers, float))

    @F.pandas_udf("boolean")
    def wrong(vectors: pd.Series, clusters: pd.Series) -> pd.Series:
        c = matrix.value
        x = np.array(vectors.tolist(), float).reshape(len(vectors), c.shape[1])
        d = np.stack([((x - center) ** 2).sum(axis=1) for center in c], axis=1)
        return pd.Series(d[np.arange(len(x)), clusters.to_numpy()] > d.min(axis=1) + slack)

    flagged = predicted.select(wrong(vector_to_array(F.col(vec)), F.col(cluster)).alias("wrong"))
    return flagged.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("wrong").alias("n_violations"))


# ---------------------------------------------------------------- forests

def fit_forest(train: DataFrame, target: str, features, seed: int = 42, trees: int = 100, depth: int = 15):
    """ML-7: random forest on the product features, all features per split, deep trees."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    va = VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="keep")
    rf = RandomForestRegressor(featuresCol="_f", labelCol=target, predictionCol="_pred", numTrees=trees, seed=seed,
                               maxDepth=depth, featureSubsetStrategy="all", minInstancesPerNode=1)
    return Pipeline(stages=[va, rf]).fit(train)


def feature_importance(model, features) -> DataFrame:
    """ML-9: (feature, importance, importance_rank), importances summing to 1."""
    rf = model.stages[-1]
    imp = rf.featureImportances.toArray().tolist()
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = sorted(zip(features, imp), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(
        [(f, float(round(v, DIGITS)), i + 1) for i, (f, v) in enumerate(rows)], "feature string, importance double, importance_rank int"
    )
