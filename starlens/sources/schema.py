"""Review schemas, NA normalisation, id-column resolution and schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Raw review record (JSONL).  rating is read as STRING so that 4, 4.0 and "4" all survive.
RAW_REVIEW = T.StructType(
    [
        T.StructField("rating", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("images", T.ArrayType(T.StructType([T.StructField("small_image_url", T.StringType())]))),
        T.StructField("asin", T.StringType()),
        T.StructField("parent_asin", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("helpful_vote", T.LongType()),
        T.StructField("verified_purchase", T.BooleanType()),
    ]
)
SCORED_REVIEW = T.StructType(RAW_REVIEW.fields + [T.StructField("predict_stars", T.IntegerType())])

# Projected review (CSV), in this column order.
PROJECTED_COLUMNS = (
    "rating", "text_word_length", "helpful_vote", "verified_purchase", "predict_stars",
    "asin", "parent_asin", "user_id", "timestamp", "title", "text",
)
PROJECTED_REVIEW = T.StructType(
    [
        T.StructField("rating", T.IntegerType()),
        T.StructField("text_word_length", T.IntegerType()),
        T.StructField("helpful_vote", T.LongType()),
        T.StructField("verified_purchase", T.IntegerType()),
        T.StructField("predict_stars", T.IntegerType()),
        T.StructField("asin", T.StringType()),
        T.StructField("parent_asin", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

# Strings read as missing from CSV (pandas' default NA list).
NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

PRODUCT_KEYS = ("product_id", "asin")
USER_KEYS = ("user_id", "reviewerID")


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def resolve_id_columns(df: DataFrame) -> DataFrame:
    """Name the product key ``product_id`` and the user key ``user_id`` (first alternative present wins)."""
    for target, options in (("product_id", PRODUCT_KEYS), ("user_id", USER_KEYS)):
        found = next((o for o in options if o in df.columns), None)
        if found and found != target:
            df = df.withColumnRenamed(found, target)
    return df


def normalise_na(df: DataFrame, columns=None, na=NA_STRINGS) -> DataFrame:
    """CSV only: turn pandas-style NA strings into NULL in string columns."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.select(
        *[F.when(F.col(c).isin(list(na)), None).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def schema_check(df: DataFrame, expected: T.StructType) -> DataFrame:
    """(column, expected, actual, status) for every expected or present column. Driver-side metadata only."""
    spark = df.sparkSession
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = []
    for f in expected.fields:
        a = actual.get(f.name)
        e = f.dataType.simpleString()
        rows.append((f.name, e, a, "ok" if a == e else ("missing" if a is None else "type_mismatch")))
    for name, a in actual.items():
        if name not in expected.fieldNames():
            rows.append((name, None, a, "unexpected"))
    return spark.createDataFrame(rows, "column string, expected string, actual string, status string")
