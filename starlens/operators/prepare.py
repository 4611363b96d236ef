"""The shared preparation steps (built once, reused by every roll-up)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.functions import features as X
from starlens.functions import text as T
from starlens.sources.schema import resolve_id_columns

MIN_TEXT_CHARS = 20


def prepare_reviews(df: DataFrame) -> DataFrame:
    """Resolve id columns and add the mismatch flag (numeric reviews)."""
    df = resolve_id_columns(df)
    return df.withColumn("is_misleading", X.misleading("predict_stars", "rating"))


def min_text(df: DataFrame, n: int = MIN_TEXT_CHARS, col: str = "review_text") -> DataFrame:
    """Keep rows whose merged text is longer than ``n`` characters (the separator counts)."""
    return df.filter(F.length(col) > n)


def prepare_texts(df: DataFrame, length_source: str = "text", min_chars: int = MIN_TEXT_CHARS) -> DataFrame:
    """Text reviews: merged text (space), length filter, word counts, gaps, buckets, flag.

    ``length_source`` picks the column whose words feed the five length buckets ("text" or "review_text");
    a null text counts 0 words, so it lands in no bucket.
    """
    df = resolve_id_columns(df)
    df = df.withColumn("review_text", T.merge_text("title", "text", " "))
    df = min_text(df, min_chars)
    return (
        df.withColumn("review_words", T.word_count("review_text"))
        .withColumn("text_length", T.word_count(length_source))
        .withColumn("length_category", X.length_bucket5("text_length"))
        .withColumn("rating_diff", X.rating_diff("predict_stars", "rating"))
        .withColumn("is_misleading", X.misleading("predict_stars", "rating"))
    )


def with_review_key(df: DataFrame, name: str = "review_id") -> DataFrame:
    """Adds a unique key to reviews that have none: the digest of the whole row and a number among equal rows.

    Equal rows are counted and dealt out again by number, so exact duplicates stay apart, the same input always gets the
    same keys, and a row that is there very often is one row per task until it is dealt out.
    """
    n, k = "_copies", "_copy"
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).cast("int").alias(n))
    dealt = counted.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n))))
    digest = F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    return dealt.select(F.concat_ws("-", digest, F.col(k).cast("string")).alias(name), *df.columns)
