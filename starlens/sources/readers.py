"""Review readers: JSONL (strict and tolerant), CSV, category from file name, unions, manifests, preview.

JSON/CSV are read with an explicit schema (no inference pass).  Row-splitting formats should be landed as
Parquet once; every later query then gets column pruning and predicate push-down at the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlens.functions import features as X
from starlens.functions.text import word_count
from starlens.sources.positions import read_csv_split
from starlens.sources.schema import (
    PROJECTED_REVIEW,
    RAW_REVIEW,
    SCORED_REVIEW,
    normalise_na,
)

CORRUPT = "_corrupt_record"
# Fixed value: shards are named <category>_{true,false}.jsonl or <category>_{train,test}_{true,false}.jsonl; a shard is a file or a folder
SHARD_PATTERN = r"(?:^|[/=])([^/=]+?)(?:_(train|test))?_(true|false)\.jsonl(?:/|$)"


def read_reviews_jsonl(spark: SparkSession, path: str, scored: bool = False) -> DataFrame:
    """Strict JSONL read: a malformed line fails the job."""
    schema = SCORED_REVIEW if scored else RAW_REVIEW
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def parse_reviews(lines: DataFrame, line: str = "value", scored: bool = True) -> DataFrame:
    """Text lines to review columns and ``reject_reason`` (null: good); no line is lost.

    Every field is parsed as text and then converted on its own: a quoted vote, a fractional timestamp, a 0/1 flag or a number as
    text keep the row.  Rejected are lines that are no JSON object (``unparsable``; blank and cut-off lines too) and rows without a
    whole-number rating in INT range (``bad_rating``: missing, not a number, NaN, too large).
    """
    schema = SCORED_REVIEW if scored else RAW_REVIEW
    names = [c for c in lines.columns if c != line]
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField(CORRUPT, T.StringType())])
    parsed = lines.withColumn("_r", F.from_json(F.col(line), as_text, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    broken = F.col("_r").isNull() | F.col(f"_r.{CORRUPT}").isNotNull() | ~F.col(line).rlike(r"^\s*\{")
    flag = F.lower(F.col("_r.verified_purchase"))
    typed = {
        "timestamp": X.to_long("_r.timestamp"),
        "helpful_vote": X.to_long("_r.helpful_vote"),
        "verified_purchase": F.when(flag.isin("true", "false"), flag == "true").otherwise(X.to_number(flag) != 0),
        "images": F.from_json(F.col("_r.images"), schema["images"].dataType),
    }
    if scored:
        typed["predict_stars"] = X.to_int("_r.predict_stars")
    reason = F.when(broken, "unparsable").when(X.to_int("_r.rating").isNull(), "bad_rating")
    return parsed.select(*names, line, reason.alias("reject_reason"), *[typed.get(f.name, F.col(f"_r.{f.name}")).alias(f.name) for f in schema.fields])


def read_reviews_tolerant(spark: SparkSession, path: str, scored: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects) of JSONL files; together they are the files' lines.  Rejects carry the file, the reason and the line."""
    schema = SCORED_REVIEW if scored else RAW_REVIEW
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"))
    tagged = parse_reviews(lines, scored=scored)
    good = tagged.filter(F.col("reject_reason").isNull()).select(*schema.fieldNames(), "source_file")
    rejects = tagged.filter(F.col("reject_reason").isNotNull()).select("source_file", "reject_reason", F.col("value").alias(CORRUPT))
    return good, rejects


def with_category(df: DataFrame, pattern: str = SHARD_PATTERN, group: int = 1, name: str = "category", source: str | None = None) -> DataFrame:
    """Derive a column from the path of the source file (e.g. the category of a shard).

    ``source`` is a path column; by default ``source_file`` where the reader carried it, else the scan's own metadata.
    """
    path = F.col(source or ("source_file" if "source_file" in df.columns else "_metadata.file_path"))
    return df.withColumn(name, F.regexp_extract(path, pattern, group))


def read_reviews_csv(
    spark: SparkSession, path: str, schema: T.StructType = PROJECTED_REVIEW, multi_line: bool | str = True
) -> DataFrame:
    """CSV with header, quotes doubled, newlines inside fields; pandas NA strings → NULL.

    ``multi_line=True`` (fields may hold line breaks) finds the records by the parity of the quotes, so a large file is read by many
    tasks; ``multi_line="whole"`` gives the same rows with one task per file; ``multi_line=False`` is for files known to keep one
    record per line.
    """
    if multi_line is True:
        return normalise_na(read_csv_split(spark, path, schema))
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", bool(multi_line))
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(path)
    )
    return normalise_na(df)


def union_categories(frames: dict[str, DataFrame]) -> DataFrame:
    """Stack category tables by column name, adding ``category``."""
    out = None
    for name, df in frames.items():
        d = df.withColumn("category", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def merge_shards(df_false: DataFrame, df_true: DataFrame) -> DataFrame:
    return df_false.unionByName(df_true, allowMissingColumns=True)


def review_projection(df: DataFrame) -> DataFrame:
    """The fixed 11 columns with defaults: rating to INT (rows without one that fits are dropped),
    words in text, helpful_vote 0, verified 0/1, ids ''."""

    def opt(c, default=None):
        return F.col(c) if c in df.columns else F.lit(default)

    rating = X.to_int("rating")
    out = df.select(
        rating.alias("rating"),
        word_count(F.coalesce(opt("text"), F.lit(""))).alias("text_word_length"),
        F.coalesce(opt("helpful_vote"), F.lit(0)).cast("bigint").alias("helpful_vote"),
        F.coalesce(opt("verified_purchase"), F.lit(False)).cast("int").alias("verified_purchase"),
        opt("predict_stars").cast("int").alias("predict_stars"),
        F.coalesce(opt("asin"), F.lit("")).alias("asin"),
        F.coalesce(opt("parent_asin"), F.lit("")).alias("parent_asin"),
        F.coalesce(opt("user_id"), F.lit("")).alias("user_id"),
        opt("timestamp").cast("bigint").alias("timestamp"),
        F.coalesce(opt("title"), F.lit("")).alias("title"),
        F.coalesce(opt("text"), F.lit("")).alias("text"),
    )
    return out.filter(F.col("rating").isNotNull())


def line_manifest(df: DataFrame, known: DataFrame | None = None, source: str = "file_path") -> DataFrame:
    """Rows per source file (full path by default: part-file names repeat across partition folders);
    with ``known`` (file_name, n_rows) only files not yet listed."""
    m = df.select(F.col(f"_metadata.{source}").alias("file_name")).groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    return m if known is None else m.join(known.select("file_name"), "file_name", "left_anti")


def row_total(df: DataFrame) -> int:
    return df.count()


def preview(df: DataFrame, n: int = 5, order_by: str | None = None) -> DataFrame:
    """First n records as pretty-printed JSON (a bounded head, ordered by a key when given)."""
    d = df.orderBy(order_by) if order_by else df
    return d.limit(n).select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("record"))
