"""Queries over V1 ``reviews`` (numeric review analysis: products, users, months)."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.functions import features as X
from starlens.operators import rollups as R
from starlens.operators.prepare import prepare_reviews
from starlens.plans.fixtures_sql import PREPARED, REVIEW_TEXTS, REVIEWS, with_ctes, word_count_sql
from starlens.plans.registry import register
from starlens.session import materialise
from starlens.sources.tables import review_texts, reviews

PRODUCT_MIN, USER_MIN, TOP_K = 20, 5, 10
BASE = with_ctes(REVIEWS, PREPARED)


def _prepared(spark, sf):
    return prepare_reviews(reviews(spark, sf))


def _top_products(df):
    return R.mismatch(df, "product_id", PRODUCT_MIN, TOP_K)


def _top_users(df):
    return R.mismatch(df, "user_id", USER_MIN, TOP_K)


def _mismatch_sql(key: str, min_reviews: int) -> str:
    return f"""
  SELECT {key}, count(*) AS review_count,
         CAST(sum(CAST(is_misleading AS INT)) AS BIGINT) AS misleading_count,
         round(sum(CAST(is_misleading AS INT)) * 100.0 / count(*), 6) AS misleading_rate_pct
  FROM prepared WHERE {key} IS NOT NULL GROUP BY {key}
  HAVING count(*) >= {min_reviews}
  ORDER BY misleading_count DESC, {key} ASC LIMIT {TOP_K}"""


TOP_PRODUCTS_CTE = f"top_products AS ({_mismatch_sql('product_id', PRODUCT_MIN)})"
TOP_USERS_CTE = f"top_users AS ({_mismatch_sql('user_id', USER_MIN)})"


@register("product_mismatch", BASE + _mismatch_sql("product_id", PRODUCT_MIN))
def product_mismatch(spark, sf):
    """AGG-8 + SRT-1: products with ≥ 20 reviews, top 10 by misleading count."""
    return _top_products(_prepared(spark, sf))


@register("user_mismatch", BASE + _mismatch_sql("user_id", USER_MIN))
def user_mismatch(spark, sf):
    """AGG-9: users with ≥ 5 reviews, top 10 by misleading count."""
    return _top_users(_prepared(spark, sf))


@register(
    "dataset_overview",
    BASE
    + """
  SELECT count(*) AS total_reviews, count(DISTINCT user_id) AS distinct_users,
         count(DISTINCT product_id) AS distinct_products,
         CAST(sum(CAST(verified_purchase AS INT)) AS BIGINT) AS verified_reviews,
         CAST(sum(CAST(is_misleading AS INT)) AS BIGINT) AS misleading_reviews,
         round(avg(CAST(is_misleading AS INT)) * 100.0, 6) AS misleading_pct,
         count(*) - CAST(sum(CAST(verified_purchase AS INT)) AS BIGINT) AS unverified_reviews
  FROM prepared""",
)
def dataset_overview(spark, sf):
    """AGG-1."""
    return R.dataset_overview(_prepared(spark, sf))


_DESCRIBE_COLS = ("rating", "predict_stars", "helpful_vote", "verified_purchase")


def _describe_sql() -> str:
    parts = []
    for c in _DESCRIBE_COLS:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"""SELECT '{c}' AS column_name, count({x}) AS n, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std,
       min({x}) AS min_value, round(quantile_cont({x}, 0.25), 6) AS p25, round(quantile_cont({x}, 0.5), 6) AS p50,
       round(quantile_cont({x}, 0.75), 6) AS p75, max({x}) AS max_value FROM prepared"""
        )
    return BASE + "\n" + "\nUNION ALL\n".join(parts)


@register("describe_numeric", _describe_sql())
def describe_numeric(spark, sf):
    """AGG-2: exact describe() of the numeric review columns."""
    return R.describe_numeric(_prepared(spark, sf), _DESCRIBE_COLS)


_PROJECTED_NUMERIC = ("rating", "text_word_length", "helpful_vote", "verified_purchase", "predict_stars", "timestamp")


def _describe_projection_sql() -> str:
    one = lambda c: f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 1) AS std,
       min({c}) AS min_value, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
       round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max_value FROM q"""  # noqa: E731
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("rating", "helpful_vote", "verified_purchase", "predict_stars", "timestamp"))
    return with_ctes(REVIEW_TEXTS, f"q AS (SELECT {cols}, CAST({word_count_sql('text')} AS DOUBLE) AS text_word_length FROM review_texts WHERE rating IS NOT NULL)") + (
        "\nUNION ALL\n".join(map(one, _PROJECTED_NUMERIC))
    )


@register("describe_projection", _describe_projection_sql())
def describe_projection(spark, sf):
    """AGG-2: exact describe() of every numeric column of the projected table, the timestamp among them."""
    from starlens.sources.readers import review_projection

    out = R.describe_numeric(review_projection(review_texts(spark, sf)), _PROJECTED_NUMERIC)
    return out.withColumn("std", F.round("std", 1))  # a timestamp's spread has no more exact digits in floating point


@register(
    "rating_distribution",
    BASE + " SELECT rating, count(*) AS n_reviews FROM prepared WHERE rating IS NOT NULL GROUP BY rating",
)
def rating_distribution(spark, sf):
    """AGG-5: reviews per star."""
    return R.value_distribution(_prepared(spark, sf), "rating")


@register(
    "predicted_distribution",
    BASE
    + " SELECT predict_stars, count(*) AS n_reviews FROM prepared WHERE predict_stars IS NOT NULL GROUP BY predict_stars",
)
def predicted_distribution(spark, sf):
    """AGG-5: reviews per predicted star."""
    return R.value_distribution(_prepared(spark, sf), "predict_stars")


@register(
    "rating_gap_distribution",
    BASE
    + """ SELECT rating - predict_stars AS rating_gap, count(*) AS n_reviews FROM prepared
  WHERE rating - predict_stars IS NOT NULL GROUP BY rating - predict_stars""",
)
def rating_gap_distribution(spark, sf):
    """AGG-6: reviews per rating gap (actual − predicted)."""
    df = _prepared(spark, sf).withColumn("rating_gap", F.col("rating") - F.col("predict_stars"))
    return R.value_distribution(df, "rating_gap")


@register(
    "rows_of_top_products",
    with_ctes(REVIEWS, PREPARED, TOP_PRODUCTS_CTE)
    + """
  SELECT review_id, product_id, rating, predict_stars FROM prepared
  WHERE product_id IN (SELECT product_id FROM top_products) AND is_misleading""",
)
def rows_of_top_products(spark, sf):
    """JON-2: misleading rows of the top-10 products (broadcast semi-join of a k-row list)."""
    df = _prepared(spark, sf)
    return R.rows_of(df, _top_products(df), "product_id", only_misleading=True).select(
        "review_id", "product_id", "rating", "predict_stars"
    )


@register(
    "rows_of_top_users",
    with_ctes(REVIEWS, PREPARED, TOP_USERS_CTE)
    + """
  SELECT review_id, user_id, rating, predict_stars, is_misleading FROM prepared
  WHERE user_id IN (SELECT user_id FROM top_users)""",
)
def rows_of_top_users(spark, sf):
    """JON-3: all rows of the top-10 users."""
    df = _prepared(spark, sf)
    return R.rows_of(df, _top_users(df), "user_id").select(
        "review_id", "user_id", "rating", "predict_stars", "is_misleading"
    )


_VLABEL = "CASE WHEN CAST(verified_purchase AS INT) = 1 THEN 'Verified' ELSE 'Unverified' END"


@register(
    "monthly_product_trend",
    with_ctes(REVIEWS, PREPARED, TOP_PRODUCTS_CTE)
    + f"""
  SELECT last_day(review_time) AS month, {_VLABEL} AS verification, count(*) AS misleading_count
  FROM prepared
  WHERE product_id IN (SELECT product_id FROM top_products) AND is_misleading
    AND review_time IS NOT NULL AND verified_purchase IS NOT NULL
  GROUP BY 1, 2""",
)
def monthly_product_trend(spark, sf):
    """AGG-10: misleading rows of the top products per month-end × verification."""
    cube = R.key_cube(_prepared(spark, sf), "product_id")
    return R.trend_from_cube(R.cube_of_top(cube, "product_id", PRODUCT_MIN, TOP_K), how="count")


@register(
    "monthly_user_trend",
    with_ctes(REVIEWS, PREPARED, TOP_USERS_CTE)
    + f"""
  SELECT last_day(review_time) AS month, user_id, {_VLABEL} AS verification,
         CAST(sum(CAST(is_misleading AS INT)) AS BIGINT) AS misleading_count
  FROM prepared
  WHERE user_id IN (SELECT user_id FROM top_users) AND review_time IS NOT NULL AND verified_purchase IS NOT NULL
  GROUP BY 1, 2, 3""",
)
def monthly_user_trend(spark, sf):
    """AGG-11: top users' rows per month-end × user × verification, sum of the flag."""
    cube = R.key_cube(_prepared(spark, sf), "user_id")
    return R.trend_from_cube(R.cube_of_top(cube, "user_id", USER_MIN, TOP_K), keys=("user_id",), how="sum")


def _rate_body(top_cte: str, key: str) -> str:
    return f"""
  SELECT {key}, {_VLABEL} AS verification, round(avg(CAST(is_misleading AS INT)) * 100.0, 6) AS misleading_rate_pct
  FROM prepared WHERE {key} IN (SELECT {key} FROM {top_cte.split()[0]}) AND verified_purchase IS NOT NULL
  GROUP BY 1, 2"""


def _rate_sql(top_cte: str, key: str) -> str:
    return with_ctes(REVIEWS, PREPARED, top_cte) + _rate_body(top_cte, key)


@register("product_rate_by_verified", _rate_sql(TOP_PRODUCTS_CTE, "product_id"))
def product_rate_by_verified(spark, sf):
    """AGG-12."""
    cube = R.key_cube(_prepared(spark, sf), "product_id")
    return R.rate_from_cube(R.cube_of_top(cube, "product_id", PRODUCT_MIN, TOP_K), "product_id")


@register("user_rate_by_verified", _rate_sql(TOP_USERS_CTE, "user_id"))
def user_rate_by_verified(spark, sf):
    """AGG-13."""
    cube = R.key_cube(_prepared(spark, sf), "user_id")
    return R.rate_from_cube(R.cube_of_top(cube, "user_id", USER_MIN, TOP_K), "user_id")


def _pivot_sql(top_cte: str, key: str) -> str:
    return with_ctes(REVIEWS, PREPARED, top_cte, f"rates AS ({_rate_body(top_cte, key)})") + f"""
  SELECT {key},
         round_even(max(CASE WHEN verification = 'Unverified' THEN misleading_rate_pct END), 2) AS unverified_rate_pct,
         round_even(max(CASE WHEN verification = 'Verified' THEN misleading_rate_pct END), 2) AS verified_rate_pct
  FROM rates GROUP BY {key}"""


@register("product_rate_pivot", _pivot_sql(TOP_PRODUCTS_CTE, "product_id"))
def product_rate_pivot(spark, sf):
    """AGG-14 (products)."""
    cube = R.key_cube(_prepared(spark, sf), "product_id")
    return R.rate_pivot(R.rate_from_cube(R.cube_of_top(cube, "product_id", PRODUCT_MIN, TOP_K), "product_id"), "product_id")


@register("user_rate_pivot", _pivot_sql(TOP_USERS_CTE, "user_id"))
def user_rate_pivot(spark, sf):
    """AGG-14 (users)."""
    cube = R.key_cube(_prepared(spark, sf), "user_id")
    return R.rate_pivot(R.rate_from_cube(R.cube_of_top(cube, "user_id", USER_MIN, TOP_K), "user_id"), "user_id")


@register(
    "top_product_pick",
    with_ctes(REVIEWS, PREPARED, TOP_PRODUCTS_CTE)
    + """, pick AS (SELECT product_id FROM top_products ORDER BY misleading_count DESC, product_id LIMIT 1)
  SELECT review_id, product_id, rating, predict_stars FROM prepared
  WHERE product_id IN (SELECT product_id FROM pick) AND is_misleading""",
)
def top_product_pick(spark, sf):
    """SRT-3: the single top product, then its misleading rows."""
    df = _prepared(spark, sf)
    pick = R.mismatch(df, "product_id", PRODUCT_MIN, 1)
    return R.rows_of(df, pick, "product_id", only_misleading=True).select(
        "review_id", "product_id", "rating", "predict_stars"
    )


@register(
    "verified_partition",
    BASE
    + f""" SELECT category, {_VLABEL} AS verification, count(*) AS n_reviews,
         CAST(sum(CAST(is_misleading AS INT)) AS BIGINT) AS misleading_count
  FROM prepared GROUP BY 1, 2""",
)
def verified_partition(spark, sf):
    """FLT-6 / FUN-9 / PRJ-10: reviews split by verification (missing → unverified), per category."""
    df = _prepared(spark, sf)
    return df.groupBy("category", X.verified_label(F.coalesce("verified_purchase", F.lit(False))).alias("verification")).agg(
        F.count(F.lit(1)).alias("n_reviews"), F.sum(F.col("is_misleading").cast("int")).cast("bigint").alias("misleading_count")
    )


@register(
    "top_product_samples",
    with_ctes(REVIEWS, PREPARED, TOP_PRODUCTS_CTE)
    + """, pick AS (SELECT product_id FROM top_products ORDER BY misleading_count DESC, product_id LIMIT 1)
  SELECT review_id, predict_stars, rating FROM prepared
  WHERE product_id IN (SELECT product_id FROM pick) AND is_misleading
  ORDER BY md5(concat_ws('|', '42', review_id)), review_id LIMIT 5""",
)
def top_product_samples(spark, sf):
    """SMP-1 on SRT-3: five seeded misleading reviews of the top product."""
    from starlens.operators import sampling as S

    df = _prepared(spark, sf)
    # the sample reads its rows three times: the top product and its rows are written once
    top = materialise(R.mismatch(df, "product_id", PRODUCT_MIN, 1).select("product_id"), "top-product")
    rows = R.rows_of(df, top, "product_id", only_misleading=True).select("review_id", "predict_stars", "rating")
    return S.sample_n(materialise(rows, "top-product-rows"), 5, ["review_id"])
