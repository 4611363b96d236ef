"""Vocabulary / TF-IDF, chart data, splits and caps, nearest centroid, regression metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.functions import features as X
from starlens.functions.text import clean_text as clean
from starlens.operators import charts as C
from starlens.operators import models as M
from starlens.operators import sampling as S
from starlens.operators import vocab as V
from starlens.operators.prepare import prepare_reviews, prepare_texts
from starlens.plans.fixtures_sql import PREPARED, REVIEW_TEXTS, REVIEWS, TEXTS_PREPARED, with_ctes
from starlens.plans.registry import register
from starlens.plans.texts import TOPIC_ID, clean_text_sql
from starlens.session import materialise
from starlens.sources.tables import review_texts, reviews, table

TOKEN_SQL = r"'[\p{L}\p{N}_]{2,}'"
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in V.STOP_WORDS_EN) + ")"
_VLABEL = "CASE WHEN CAST(verified_purchase AS INT) = 1 THEN 'Verified' ELSE 'Unverified' END"
RQ2_MIN_DF, RQ2_MAX_DF, RQ2_FEATURES = 10, 0.95, 1000
RQ3_MIN_DF, RQ3_MAX_DF = 2, 0.95


def _dt_sql(src: str, text: str) -> str:
    return f"""dt AS (SELECT review_id, term, count(*) AS tf FROM (
      SELECT review_id, unnest(regexp_extract_all(lower(coalesce({text}, '')), {TOKEN_SQL})) AS term FROM {src})
    WHERE term NOT IN {STOP_SQL} GROUP BY review_id, term),
  nd AS (SELECT count(*) AS n FROM {src})"""


def _vocab_sql(min_df, max_df, limit) -> str:
    lim = f" ORDER BY term_count DESC, term LIMIT {limit}" if limit else ""
    return f"""vocab AS (SELECT term, sum(tf) AS term_count, count(*) AS doc_freq FROM dt GROUP BY term
    HAVING count(*) >= {min_df} AND count(*) <= {max_df} * (SELECT n FROM nd){lim})"""


RQ2_CTES = with_ctes(REVIEW_TEXTS, TEXTS_PREPARED, _dt_sql("texts_prepared", "review_text"), _vocab_sql(RQ2_MIN_DF, RQ2_MAX_DF, RQ2_FEATURES))
RQ2_TFIDF = (
    RQ2_CTES
    + """, tfidf AS (SELECT review_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY review_id)) AS weight FROM (
      SELECT dt.review_id, dt.term, tf * (ln((1.0 + n) / (1.0 + doc_freq)) + 1.0) AS w FROM dt JOIN vocab USING (term), nd))"""
)
RQ3_CTES = with_ctes(
    REVIEW_TEXTS,
    f"clean AS (SELECT *, {clean_text_sql('text')} AS clean_text FROM review_texts)",
    _dt_sql("clean", "clean_text"),
    _vocab_sql(RQ3_MIN_DF, RQ3_MAX_DF, None),
)


def _rq2(spark, sf):
    d = prepare_texts(review_texts(spark, sf))
    stats, n = V.corpus_terms(d, "review_text")
    return d, V.term_stats(stats, n, RQ2_MIN_DF, RQ2_MAX_DF, RQ2_FEATURES), n


def _rq3(spark, sf, keep):
    d = V.counted(review_texts(spark, sf).withColumn("clean_text", clean("text")), "clean_text", [keep])
    stats, n = V.corpus_terms(d, "clean_text")
    return d, V.term_stats(stats, n, RQ3_MIN_DF, RQ3_MAX_DF, None)


@register(
    "term_stats",
    RQ2_CTES + " SELECT term, term_count, doc_freq, row_number() OVER (ORDER BY term_count DESC, term) - 1 AS term_rank FROM vocab",
)
def term_stats(spark, sf):
    """TXT-1: vocabulary of merged review text — stop words out, 10 ≤ df ≤ 95 %, top 1,000 by count."""
    return _rq2(spark, sf)[1]


@register("tfidf", RQ2_TFIDF + " SELECT review_id, term, round(weight, 6) AS weight FROM tfidf")
def tfidf(spark, sf):
    """TXT-2: smooth-idf TF-IDF, L2-normalised per review, long form."""
    d, vocab, n = _rq2(spark, sf)
    return V.tfidf(d, "review_text", ["review_id"], vocab, n).select("review_id", "term", F.round("weight", 6).alias("weight"))


@register(
    "top_terms_per_topic",
    RQ2_TFIDF
    + """, cw AS (SELECT topic, term, sum(weight) / any_value(sz) AS weight FROM tfidf
      JOIN (SELECT review_id, topic, count(*) OVER (PARTITION BY topic) AS sz FROM texts_prepared) USING (review_id)
      GROUP BY topic, term)
  SELECT topic, term, round(weight, 6) AS weight, term_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS term_rank FROM cw) WHERE term_rank <= 10""",
)
def top_terms_per_topic(spark, sf):
    """SRT-2: per topic, the 10 terms with the largest centroid (mean TF-IDF) weight."""
    d, vocab, n = _rq2(spark, sf)
    w = V.tfidf(d, "review_text", ["topic"], vocab, n)
    cw = V.centroid_weights(w, d.groupBy("topic").agg(F.count(F.lit(1)).alias("n")), "topic")
    return V.top_terms(cw, "topic", 10).select("topic", "term", F.round("weight", 6).alias("weight"), "term_rank")


@register("count_matrix", RQ3_CTES + " SELECT review_id, term, tf FROM dt JOIN vocab USING (term)")
def count_matrix(spark, sf):
    """TXT-3: term counts of cleaned text, 2 ≤ df ≤ 95 %, every such term, long form."""
    d, vocab = _rq3(spark, sf, "review_id")
    return V.count_matrix(V.doc_terms(d, "clean_text", ["review_id"]), vocab).select("review_id", "term", "tf")


@register(
    "cluster_keywords",
    RQ3_CTES
    + """, s AS (SELECT topic, term, sum(tf) AS term_count FROM dt JOIN vocab USING (term)
      JOIN (SELECT review_id, topic FROM clean) USING (review_id) GROUP BY topic, term)
  SELECT topic, term, term_count, term_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY topic ORDER BY term_count DESC, term) AS term_rank FROM s) WHERE term_rank <= 10""",
)
def cluster_keywords(spark, sf):
    """AGG-22: per cluster (here the given topic), the 10 terms with the largest summed count."""
    d, vocab = _rq3(spark, sf, "topic")
    counts = V.count_matrix(V.doc_terms(d, "clean_text", ["topic"]), vocab)
    return V.cluster_keywords(counts, "topic").select(
        "topic", "term", "term_count", "term_rank"
    )


@register(
    "length_histogram",
    with_ctes(REVIEW_TEXTS, TEXTS_PREPARED)
    + """, s AS (SELECT CAST(min(review_words) AS DOUBLE) AS lo, CAST(max(review_words) AS DOUBLE) AS hi FROM texts_prepared),
  b AS (SELECT CAST(least(floor((CAST(review_words AS DOUBLE) - lo) * 50 / (hi - lo)) + 1, 50) AS INT) AS bin, count(*) AS n
        FROM texts_prepared, s GROUP BY 1)
  SELECT CAST(g.bin AS INT) AS bin, round(lo + (g.bin - 1) * ((hi - lo) / 50), 6) AS bin_lo,
         round(lo + g.bin * ((hi - lo) / 50), 6) AS bin_hi, CAST(coalesce(b.n, 0) AS BIGINT) AS n
  FROM range(1, 51) g(bin) CROSS JOIN s LEFT JOIN b ON b.bin = g.bin""",
)
def length_histogram(spark, sf):
    """VIZ-1: 50 equal-width bins of review word counts (empty bins reported as 0)."""
    return C.histogram(prepare_texts(review_texts(spark, sf)), "review_words", 50)


def _kde_sql(value: str, group: str) -> str:
    return with_ctes(REVIEW_TEXTS, TEXTS_PREPARED) + f""", t1 AS (SELECT {group} AS grp, CAST({value} AS DOUBLE) AS x
          FROM texts_prepared WHERE topic = {TOPIC_ID} AND {value} IS NOT NULL),
  st AS (SELECT grp, count(x) AS n, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi FROM t1 GROUP BY 1
         HAVING count(x) >= 2 AND stddev_samp(x) > 0),
  p AS (SELECT grp, n, sd * pow(n, -0.2) AS h, lo, hi FROM st),
  g AS (SELECT grp, k AS point, (lo - 3.0 * h) + k * ((hi - lo + 6.0 * h) / 199) AS gx, h, n FROM p, range(0, 200) r(k))
  SELECT g.grp AS {_KDE_GROUP}, CAST(point AS INT) AS point, round(gx, 6) AS x,
         round(sum(exp(-0.5 * ((gx - x) / h) * ((gx - x) / h)) / sqrt(2 * pi()) / (h * n)), 6) AS density
  FROM g JOIN t1 USING (grp) GROUP BY g.grp, point, gx"""


_KDE_GROUP = "review_group"
_CLS = "CASE WHEN review_words >= 50 THEN 'Long' ELSE 'Short' END"


def _kde(spark, sf, value, group_col):
    d = prepare_texts(review_texts(spark, sf)).filter(F.col("topic") == TOPIC_ID)
    d = d.withColumn(_KDE_GROUP, group_col)
    return C.kde(d, value, _KDE_GROUP, 200)


@register("kde_text_length", _kde_sql("review_words", _VLABEL))
def kde_text_length(spark, sf):
    """VIZ-2: Gaussian density of word counts in topic 1, verified vs unverified (200-point grid)."""
    return _kde(spark, sf, "review_words", X.verified_label("verified_purchase"))


@register("kde_rating_diff", _kde_sql("rating_diff", _VLABEL))
def kde_rating_diff(spark, sf):
    """VIZ-2: density of (predict − rating) in topic 1, verified vs unverified."""
    return _kde(spark, sf, "rating_diff", X.verified_label("verified_purchase"))


@register("kde_rating_diff_by_length", _kde_sql("rating_diff", _CLS))
def kde_rating_diff_by_length(spark, sf):
    """VIZ-2: density of (predict − rating) in topic 1, long (≥ 50 words) vs short reviews."""
    return _kde(spark, sf, "rating_diff", X.length_bucket2("review_words"))


@register("kde_rating_diff_by_group", _kde_sql("rating_diff", f"concat_ws(' + ', {_VLABEL}, {_CLS})"))
def kde_rating_diff_by_group(spark, sf):
    """VIZ-2: density of (predict − rating) in topic 1 per verification + length group."""
    return _kde(spark, sf, "rating_diff", X.group_label(X.length_bucket2("review_words"), "verified_purchase", "verified_first"))


@register("kde_length_all", _kde_sql("review_words", "'all'").replace(f"WHERE topic = {TOPIC_ID} AND", "WHERE"))
def kde_length_all(spark, sf):
    """VIZ-2: the density drawn over the word-count histogram of all reviews."""
    d = prepare_texts(review_texts(spark, sf)).withColumn(_KDE_GROUP, F.lit("all"))
    return C.kde(d, "review_words", _KDE_GROUP, 200)


@register(
    "kde_price",
    """WITH t AS (SELECT l_returnflag AS grp, CAST(l_extendedprice AS DOUBLE) / 1000 AS x FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL),
  st AS (SELECT grp, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h, min(x) AS lo, max(x) AS hi FROM t GROUP BY grp),
  g AS (SELECT grp, k AS point, (lo - 3.0 * h) + k * ((hi - lo + 6.0 * h) / 199) AS gx, h, n FROM st, range(0, 200) r(k) WHERE n >= 2 AND h > 0)
  SELECT g.grp AS l_returnflag, CAST(point AS INT) AS point, round(gx, 6) AS x,
         round(sum(exp(-0.5 * ((gx - x) / h) * ((gx - x) / h))) / sqrt(2 * pi()) / any_value(h * n), 6) AS density
  FROM g JOIN t USING (grp) GROUP BY g.grp, point, gx""",
)
def kde_price(spark, sf):
    """VIZ-2 on a column of many distinct values: density of line prices (thousands) by return flag, from binned moments."""
    d = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_extendedprice").cast("double") / 1000).alias("price"))
    return C.kde_binned(d, "price", "l_returnflag", 200).withColumn("x", F.round("x", 6)).withColumn("density", F.round("density", 6))


@register(
    "box_rating_diff",
    with_ctes(REVIEW_TEXTS, TEXTS_PREPARED)
    + f""", t1 AS (SELECT {_VLABEL} AS verification, CAST(rating_diff AS DOUBLE) AS x FROM texts_prepared
               WHERE topic = {TOPIC_ID} AND rating_diff IS NOT NULL),
  st AS (SELECT verification, count(x) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
                quantile_cont(x, 0.75) AS q3 FROM t1 GROUP BY 1)
  SELECT verification, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
         round(min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN x END), 6) AS whisker_low,
         round(max(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN x END), 6) AS whisker_high,
         count_if(NOT (x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1))) AS n_outliers
  FROM t1 JOIN st USING (verification) GROUP BY verification, n, q1, median, q3""",
)
def box_rating_diff(spark, sf):
    """VIZ-3: box-plot statistics of (predict − rating) in topic 1 by verification."""
    d = prepare_texts(review_texts(spark, sf)).filter(F.col("topic") == TOPIC_ID)
    d = d.withColumn("verification", X.verified_label("verified_purchase"))
    return C.box_stats(d, "rating_diff", "verification")


def _h(key="review_id"):
    return f"md5(concat_ws('|', '{S.DEFAULT_SEED}', CAST({key} AS VARCHAR)))"


@register(
    "stratified_split",
    with_ctes(REVIEWS)
    + f""" SELECT review_id, category, verified_purchase,
         CASE WHEN row_number() OVER (PARTITION BY category, verified_purchase ORDER BY {_h()}, review_id)
                   <= floor(0.8 * count(*) OVER (PARTITION BY category, verified_purchase)) THEN 'train' ELSE 'test' END AS split
  FROM reviews""",
)
def stratified_split(spark, sf):
    """SPL-1: per category × verification, the first ⌊0.8·n⌋ rows in seeded hash order are train."""
    d = reviews(spark, sf).select("review_id", "category", "verified_purchase")
    return S.stratified_split(d, ["category", "verified_purchase"], ["review_id"], 0.8)


@register(
    "train_test_split",
    with_ctes(REVIEWS)
    + f""" SELECT review_id, CASE WHEN row_number() OVER (ORDER BY {_h()}, review_id)
                   <= count(*) OVER () - ceil(0.2 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split
  FROM reviews""",
)
def train_test_split(spark, sf):
    """SPL-2: one seeded split, test = ⌈0.2·n⌉ rows."""
    return S.train_test(reviews(spark, sf).select("review_id"), ["review_id"], 0.2)


@register("shuffle_rows", with_ctes(REVIEW_TEXTS) + f" SELECT review_id, {_h()} AS shuffle_key FROM review_texts")
def shuffle_rows(spark, sf):
    """SPL-3: seeded shuffle order (range-sorted by the hash key)."""
    return S.shuffled(review_texts(spark, sf).select("review_id"), ["review_id"])


CAP = 500_000


def _capped_rows(spark, sf):
    """The cap counts, refines and labels its rows: written once, so that the tables are joined once."""
    return materialise(reviews(spark, sf).select("review_id", "category"), "cap-rows", "zstd")


@register(
    "cap_per_category",
    with_ctes(REVIEWS)
    + f""" SELECT review_id, category FROM (
    SELECT review_id, category, row_number() OVER (PARTITION BY category ORDER BY {_h()}, review_id) AS rk FROM reviews)
  WHERE rk <= {CAP}""",
)
def cap_per_category(spark, sf):
    """CAP-1: at most 500,000 rows per category (hash order)."""
    return S.cap_per_group(_capped_rows(spark, sf), "category", CAP, ["review_id"])


CAP_SMALL = 30


@register(
    "cap_small",
    with_ctes(REVIEWS)
    + f""" SELECT review_id, category FROM (
    SELECT review_id, category, row_number() OVER (PARTITION BY category ORDER BY {_h()}, review_id) AS rk FROM reviews)
  WHERE rk <= {CAP_SMALL}""",
)
def cap_small(spark, sf):
    """CAP-1 with a cap that binds: at most 30 rows per category (hash order)."""
    return S.cap_per_group(_capped_rows(spark, sf), "category", CAP_SMALL, ["review_id"])


@register(
    "nearest_centroid",
    """WITH e AS (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
  c AS (SELECT label AS c_label, i, avg(CAST(v AS DOUBLE)) AS m FROM e GROUP BY 1, 2),
  d AS (SELECT e.vec_id, c.c_label, sum((CAST(e.v AS DOUBLE) - c.m) * (CAST(e.v AS DOUBLE) - c.m)) AS dist
        FROM e JOIN c USING (i) GROUP BY 1, 2),
  best AS (SELECT vec_id, first(c_label ORDER BY dist, c_label) AS cluster FROM d GROUP BY vec_id)
  SELECT vec_id, label, cluster FROM embeddings JOIN best USING (vec_id)""",
)
def nearest_centroid(spark, sf):
    """JON-6: each embedding to the nearest per-label mean vector."""
    e = table(spark, sf, "embeddings")
    cents = M.mean_vectors(e, "label", "embedding")
    return M.nearest_centroid(e, cents, "embedding", "label").select("vec_id", "label", "cluster")


@register(
    "regression_metrics",
    with_ctes(REVIEWS)
    + """, s AS (SELECT count(*) AS n, sum((CAST(rating AS DOUBLE) - predict_stars) * (CAST(rating AS DOUBLE) - predict_stars)) AS sse,
                sum(CAST(rating AS DOUBLE)) AS sy, sum(CAST(rating AS DOUBLE) * rating) AS syy
         FROM reviews WHERE rating IS NOT NULL AND predict_stars IS NOT NULL)
  SELECT n, round(1 - sse / (syy - sy * sy / n), 6) AS r2, round(sqrt(sse / n), 6) AS rmse FROM s""",
)
def regression_metrics(spark, sf):
    """ML-8: R² and RMSE of predicted stars against ratings."""
    return M.regression_metrics(reviews(spark, sf), "rating", "predict_stars")
