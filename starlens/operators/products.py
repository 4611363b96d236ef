"""Per-product measures: means, dominant topic, reputation risk and sales proxy — one aggregate.

The reference computes stats, risk and size as three group-bys plus a join; here they are one ``groupBy``
(one shuffle, partial aggregation on the map side).  ``stats_with_risk`` keeps the explicit join form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.functions import features as X

DIGITS = 6
FEATURES = ("rating", "sentiment", "text_length", "image_count", "time_weight", "helpful_vote", "verified_purchase")


CARRY = ("asin", "rating", "helpful_vote", "verified_purchase", "timestamp", "topic", "image_count")


def review_inputs(df: DataFrame) -> DataFrame:
    """The small per-review columns carried through sentiment scoring."""
    return df.withColumn("image_count", X.image_count("images"))


def product_features(df: DataFrame) -> DataFrame:
    """Per-review features on top of scored reviews (``n_words`` = words of the cleaned text)."""
    return (
        df.withColumn("text_length", F.col("n_words"))
        .withColumn("time_weight", X.time_weight("timestamp"))
        .withColumn("verified_purchase", F.col("verified_purchase").cast("int"))
    )


def _risk(s: str = "sentiment") -> F.Column:
    n = F.count(F.lit(1))
    neg = F.count_if(F.col(s) < 0)
    return n / (neg + 1) * F.abs(F.avg(s))


def product_stats(df: DataFrame, key: str = "asin") -> DataFrame:
    """Means of the features, modal topic (smallest on tie), reputation risk and log1p(review count)."""
    means = [F.round(F.avg(F.col(c).cast("double")), DIGITS).alias(c) for c in FEATURES]
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            *means,
            F.mode("topic", deterministic=True).alias("topic"),
            F.round(_risk(), DIGITS).alias("reputation_risk"),
            F.round(F.log1p(F.count(F.lit(1))), DIGITS).alias("sales_proxy"),
        )
    )


def reputation_risk(df: DataFrame, key: str = "asin") -> DataFrame:
    """n / (negatives + 1) · |mean sentiment| per product."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.round(_risk(), DIGITS).alias("reputation_risk"))


def sales_proxy(df: DataFrame, key: str = "asin") -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.round(F.log1p(F.count(F.lit(1))), DIGITS).alias("sales_proxy"))


def stats_with_risk(stats: DataFrame, risk: DataFrame, key: str = "asin") -> DataFrame:
    """Inner equi-join on the product key (both sides are per-product aggregates, hash-partitioned alike)."""
    return stats.join(risk, key, "inner")
