"""Sources, sinks and streaming, exercised as round trips over data derived from the driver tables.

Every landed file goes under a fresh folder of the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from starlens.plans.fixtures_sql import REVIEW_TEXTS, with_ctes, word_count_sql
from starlens.plans.products import PRODUCT_CTES, product_stats_df
from starlens.plans.registry import register, side_by_side
from starlens.functions import features as X
from starlens.operators import sampling as S
from starlens.operators.prepare import with_review_key
from starlens.session import materialise, scratch_path
from starlens.sources import readers as RD
from starlens.sources import sinks as SK
from starlens.sources.schema import NA_STRINGS, PROJECTED_REVIEW, has_column, schema_check
from starlens.sources.tables import review_texts, table
from starlens.streaming.ingest import job_metrics, read_latest, stream_ingest, stream_monthly_trend, unseen_files

_VSTR = "CASE WHEN verified_purchase THEN 'true' ELSE 'false' END"


def scored_records(spark, sf):
    """V2 as raw scored review records (F2): rating as text, images as structs."""
    d = review_texts(spark, sf)
    images = F.transform("images", lambda x: F.struct(x.alias("small_image_url")))
    return d.select(
        F.col("rating").cast("string").alias("rating"),
        "title",
        "text",
        images.alias("images"),
        "asin",
        F.lit(None).cast("string").alias("parent_asin"),
        "user_id",
        "timestamp",
        "helpful_vote",
        "verified_purchase",
        "predict_stars",
        "category",
        "review_id",
    )


def _land_jsonl(spark, sf):
    path = scratch_path(spark, "reviews-jsonl")
    SK.write_partitioned(scored_records(spark, sf), path, fmt="json", partition_by=("category", "verified_purchase"))
    return path


@register(
    "jsonl_round_trip",
    with_ctes(REVIEW_TEXTS)
    + f" SELECT category, {_VSTR} AS verified_purchase, count(*) AS n_rows FROM review_texts GROUP BY 1, 2",
)
def jsonl_round_trip(spark, sf):
    """SNK-1 → SRC-1 → SRC-3 → SRC-9: shard by category × verification, read strictly, count lines per file,
    roll the manifest up by the category and flag parsed from each file's path."""
    path = _land_jsonl(spark, sf)
    back = RD.read_reviews_jsonl(spark, path, scored=True)
    man = RD.line_manifest(back.select("_metadata"))
    man = man.withColumn("category", F.regexp_extract("file_name", r"category=([^/]+)", 1)).withColumn(
        "verified_purchase", F.regexp_extract("file_name", r"verified_purchase=([^/]+)", 1)
    )
    return man.groupBy("category", "verified_purchase").agg(F.sum("n_rows").cast("bigint").alias("n_rows"))


@register(
    "merge_shards",
    with_ctes(REVIEW_TEXTS)
    + " SELECT category, count(*) AS n_rows, CAST(sum(CAST(verified_purchase AS INT)) AS BIGINT) AS n_verified,"
    " count(DISTINCT review_id) AS n_ids FROM review_texts GROUP BY category",
)
def merge_shards(spark, sf):
    """SRC-6 / SRC-5 / SET-1: read the false and true shards separately and stack them by name."""
    path = _land_jsonl(spark, sf)
    parts = {}
    for flag in ("false", "true"):
        parts[flag] = (
            spark.read.schema(scored_records(spark, sf).drop("category", "verified_purchase").schema)
            .option("basePath", path)
            .json(os.path.join(path, "category=*", f"verified_purchase={flag}"))
            .withColumn("verified_purchase", F.lit(flag == "true"))
        )
    m = RD.merge_shards(parts["false"], parts["true"])
    return m.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("verified_purchase").cast("int")).cast("bigint").alias("n_verified"),
        F.count_distinct("review_id").alias("n_ids"),
    )


@register("row_total", with_ctes(REVIEW_TEXTS) + " SELECT count(*) AS n_rows FROM review_texts")
def row_total(spark, sf):
    """SRC-10: rows of a landed file set (metadata-only count over the shards)."""
    back = RD.read_reviews_jsonl(spark, _land_jsonl(spark, sf), scored=True)
    return back.agg(F.count(F.lit(1)).alias("n_rows"))


@register("preview")
def preview(spark, sf):
    """SRC-8: the first 5 records (by key) pretty-printed as JSON."""
    return RD.preview(scored_records(spark, sf), 5, order_by="review_id")


@register(
    "preview_fields",
    with_ctes(REVIEW_TEXTS) + " SELECT CAST(review_id AS VARCHAR) AS review_id, asin, CAST(rating AS VARCHAR) AS rating, user_id, true AS several_lines FROM review_texts ORDER BY review_texts.review_id LIMIT 5",
)
def preview_fields(spark, sf):
    """SRC-8, checked: the five pretty-printed records parse back to the first five reviews."""
    r = preview(spark, sf)
    get = lambda c: F.get_json_object("record", f"$.{c}").alias(c)
    return r.select(*map(get, ("review_id", "asin", "rating", "user_id")), F.contains("record", F.lit("\n")).alias("several_lines"))


def _na(expr: str) -> str:
    na = ", ".join("'" + v.replace("'", "''") + "'" for v in NA_STRINGS)
    return f"CASE WHEN {expr} IN ({na}) THEN NULL ELSE {expr} END"


@register(
    "csv_round_trip",
    with_ctes(REVIEW_TEXTS)
    + f"""
  SELECT rating, {word_count_sql('text')} AS text_word_length, coalesce(helpful_vote, 0) AS helpful_vote,
         CAST(coalesce(verified_purchase, false) AS INT) AS verified_purchase, predict_stars,
         {_na("coalesce(asin, '')")} AS asin, CAST(NULL AS VARCHAR) AS parent_asin, {_na("coalesce(user_id, '')")} AS user_id,
         timestamp, {_na("coalesce(title, '')")} AS title, {_na("coalesce(text, '')")} AS text
  FROM review_texts WHERE rating IS NOT NULL""",
)
def csv_round_trip(spark, sf):
    """PRJ-1 → SNK-3 → SRC-4: fixed 11-column CSV (quotes doubled, multi-line fields) and back, NA strings → NULL."""
    path = scratch_path(spark, "reviews-csv")
    SK.write_projection_csv(RD.review_projection(review_texts(spark, sf)), path)
    return RD.read_reviews_csv(spark, path)


@register(
    "tolerant_read",
    with_ctes(REVIEW_TEXTS)
    + """ SELECT CASE WHEN review_id % 50 = 0 THEN 'unparsable' WHEN review_id % 37 = 0 THEN 'bad_rating' ELSE 'good' END
         AS outcome, count(*) AS n_rows FROM review_texts GROUP BY 1""",
)
def tolerant_read(spark, sf):
    """SRC-2: lines that do not parse and ratings that do not coerce become rejects (with file and reason)."""
    rec = scored_records(spark, sf).withColumn(
        "rating", F.when(F.col("review_id") % 37 == 0, F.lit("x")).otherwise(F.col("rating"))
    )
    line = F.to_json(F.struct(*[c for c in rec.columns]))
    broken = F.when(F.col("review_id") % 50 == 0, F.substring(line, 1, 25)).otherwise(line)
    path = scratch_path(spark, "reviews-dirty")
    rec.select(broken.alias("value")).write.mode("overwrite").text(path)
    good, rejects = RD.read_reviews_tolerant(spark, path)
    return good.select(F.lit("good").alias("outcome")).unionByName(
        rejects.select(F.col("reject_reason").alias("outcome"))
    ).groupBy("outcome").agg(F.count(F.lit(1)).alias("n_rows"))


# A landing of dirty lines, by review_id % 12: 0 plain, 1 quoted vote, 2 fractional timestamp, 3 flag as 1, 4 number as text and images
# that are no list, 5 rating NaN, 6 rating 1e12, 7 cut-off line, 8 no rating, 9 rating "4.0", 10 blank line, 11 rating 3.0
def _dirty_lines(spark, sf):
    v, i = F.col("review_id") % 12, F.col("review_id").cast("string")
    rating = (
        F.when(v == 5, '"rating": NaN, ').when(v == 6, '"rating": 1e12, ').when(v == 8, "").when(v == 9, '"rating": "4.0", ')
        .when(v == 11, '"rating": 3.0, ').otherwise('"rating": 5, ')
    )
    line = F.concat(
        F.lit('{"user_id": "U'), i, F.lit('", '), rating,
        F.when(v == 1, '"helpful_vote": "3", ').otherwise('"helpful_vote": 3, '),
        F.when(v == 2, F.concat(F.lit('"timestamp": '), i, F.lit(".75, "))).otherwise(F.concat(F.lit('"timestamp": '), i, F.lit(", "))),
        F.when(v == 3, '"verified_purchase": 1, ').otherwise('"verified_purchase": true, '),
        F.when(v == 4, '"images": "none", "text": 7').otherwise('"images": [{"small_image_url": "u"}], "text": "seven"'),
        F.lit("}"),
    )
    value = F.when(v == 7, F.substring(line, 1, 30)).when(v == 10, "").otherwise(line)
    path = scratch_path(spark, "reviews-mixed")
    table(spark, sf, "documents").select(F.col("doc_id").alias("review_id")).select(value.alias("value")).write.mode("overwrite").text(path)
    return path


@register(
    "tolerant_types",
    """SELECT 'U' || doc_id AS user_id, CASE doc_id % 12 WHEN 9 THEN 4 WHEN 11 THEN 3 ELSE 5 END AS rating, CAST(3 AS BIGINT) AS helpful_vote,
       doc_id AS timestamp, true AS verified_purchase, CASE WHEN doc_id % 12 = 4 THEN '7' ELSE 'seven' END AS text,
       CASE WHEN doc_id % 12 = 4 THEN 0 ELSE 1 END AS n_images
  FROM documents WHERE doc_id % 12 NOT IN (5, 6, 7, 8, 10)""",
)
def tolerant_types(spark, sf):
    """SRC-2 / PRJ-1: mistyped fields are converted one by one; only lines without a usable rating or object are left out."""
    good, _ = RD.read_reviews_tolerant(spark, _dirty_lines(spark, sf))
    p = RD.review_projection(good.select("*", F.lit(None).alias("category")))
    return good.select(
        "user_id", X.to_int("rating").alias("rating"), "helpful_vote", "timestamp", "verified_purchase", "text", F.coalesce(F.size("images"), F.lit(0)).alias("n_images")
    ).join(p.select("user_id"), "user_id")


@register(
    "tolerant_lines",
    """SELECT count(*) AS n_lines, count_if(doc_id % 12 NOT IN (5, 6, 7, 8, 10)) AS n_good, count_if(doc_id % 12 NOT IN (5, 6, 7, 8, 10)) AS n_good_counted,
       count_if(doc_id % 12 IN (7, 10)) AS n_unparsable, count_if(doc_id % 12 IN (5, 6, 8)) AS n_bad_rating FROM documents""",
)
def tolerant_lines(spark, sf):
    """SRC-2: good rows and rejects are all lines, however many columns are read."""
    path = _dirty_lines(spark, sf)
    good, rejects = RD.read_reviews_tolerant(spark, path)
    whole = good.agg(F.count(F.to_json(F.struct(*good.columns))).alias("n_good"))  # reads every column
    why = rejects.agg(
        F.count_if(F.col("reject_reason") == "unparsable").alias("n_unparsable"), F.count_if(F.col("reject_reason") == "bad_rating").alias("n_bad_rating")
    )
    lines = spark.read.text(path).agg(F.count(F.lit(1)).alias("n_lines"))
    counted = spark.createDataFrame([(good.count(),)], "n_good_counted long")
    return side_by_side(lines, whole, counted, why)


def _shards(spark, sf):
    """JSONL shards named <category>_<verified>.jsonl, as folders."""
    rec = scored_records(spark, sf)
    flag = F.when(F.col("verified_purchase"), "true").otherwise("false")
    path = scratch_path(spark, "named-shards")
    rec.withColumn("shard", F.concat(F.col("category"), F.lit("_"), flag, F.lit(".jsonl"))).drop("category").write.partitionBy("shard").json(path)
    return path


@register(
    "category_from_file",
    with_ctes(REVIEW_TEXTS) + " SELECT category, CASE WHEN verified_purchase THEN 'true' ELSE 'false' END AS flag, count(*) AS n_rows FROM review_texts GROUP BY 1, 2",
)
def category_from_file(spark, sf):
    """SRC-3: category and flag from the shard's name."""
    raw = RD.read_reviews_jsonl(spark, _shards(spark, sf), scored=True)
    d = RD.with_category(RD.with_category(raw), group=3, name="flag")
    return d.groupBy("category", "flag").agg(F.count(F.lit(1)).alias("n_rows"))


@register(
    "union_categories",
    with_ctes(REVIEW_TEXTS) + " SELECT category, count(*) AS n_rows, count(DISTINCT review_id) AS n_ids, count_if(category = 'en') AS n_with_topic FROM review_texts GROUP BY category",
)
def union_categories(spark, sf):
    """SRC-5: one frame per category, with different columns, stacked by name."""
    rec = review_texts(spark, sf)
    names = [r[0] for r in rec.select("category").distinct().orderBy("category").collect()]  # one name per category table
    frames = {n: rec.where(F.col("category") == n).select("review_id", *(["topic"] if n == "en" else [])) for n in names}
    u = RD.union_categories(frames)
    return u.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("review_id").alias("n_ids"), F.count("topic").alias("n_with_topic")
    )


@register(
    "schema_check",
    with_ctes(REVIEW_TEXTS)
    + """, n AS (SELECT count(*) AS n FROM review_texts WHERE rating IS NOT NULL)
  SELECT t.*, CASE WHEN t."column" = 'parent_asin' OR actual IS NOT NULL THEN n END AS n_values FROM n,
       (VALUES ('rating', 'int', 'int', 'ok'), ('text_word_length', 'int', 'int', 'ok'), ('helpful_vote', 'bigint', 'bigint', 'ok'),
       ('verified_purchase', 'int', 'string', 'type_mismatch'), ('predict_stars', 'int', NULL, 'missing'), ('asin', 'string', 'string', 'ok'),
       ('parent_asin', 'string', 'string', 'ok'), ('user_id', 'string', 'string', 'ok'), ('timestamp', 'bigint', 'bigint', 'ok'),
       ('title', 'string', 'string', 'ok'), ('text', 'string', 'string', 'ok'), ('extra', NULL, 'double', 'unexpected'))
       AS t("column", expected, actual, status)""",
)
def schema_check_q(spark, sf):
    """SRC-7: a projected table as landed, with one column of another type, one missing and one too many, and the values each column holds."""
    p = RD.review_projection(review_texts(spark, sf))
    p = p.withColumn("verified_purchase", F.col("verified_purchase").cast("string")).drop("predict_stars").withColumn("extra", F.lit(0.5))
    landed = materialise(p, "schema-landed")
    held = landed.agg(*[F.count(c).alias(c) for c in landed.columns])
    held = held.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, landed.columns)), F.array(*landed.columns))).alias("column", "n_values"))
    return schema_check(landed, PROJECTED_REVIEW).join(held, "column", "left")


@register(
    "optional_column_guard",
    with_ctes(REVIEW_TEXTS)
    + f""" SELECT 'with' AS source, {_VSTR} AS verified_purchase, count(*) AS n_rows FROM review_texts GROUP BY 1, 2
  UNION ALL SELECT 'without', 'all', count(*) FROM review_texts""",
)
def optional_column_guard(spark, sf):
    """PRJ-3: the per-verification counts run only where the column exists; the total stands in for them elsewhere."""
    rec = review_texts(spark, sf)

    def counts(df, name):
        flag = F.col("verified_purchase").cast("string") if has_column(df, "verified_purchase") else F.lit("all")
        return df.groupBy(flag.alias("verified_purchase")).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("source"), "*")

    return counts(rec, "with").unionByName(counts(rec.drop("verified_purchase"), "without"))


@register(
    "manifest_incremental",
    with_ctes(REVIEW_TEXTS)
    + """ SELECT 'known' AS state, category, count(*) AS n_rows FROM review_texts WHERE review_id % 3 <> 0 GROUP BY 2
  UNION ALL SELECT 'new', category, count(*) FROM review_texts WHERE review_id % 3 = 0 GROUP BY 2""",
)
def manifest_incremental(spark, sf):
    """SRC-9: lines per file; after more files have landed beside files of the same names, only those are counted."""
    path = scratch_path(spark, "manifest")
    rec = scored_records(spark, sf)
    land = lambda cond: rec.filter(cond).write.mode("append").partitionBy("category").json(path)
    read = lambda: RD.read_reviews_jsonl(spark, path, scored=True).select("_metadata")
    land(F.col("review_id") % 3 != 0)
    known = materialise(RD.line_manifest(read()), "manifest-known")
    land(F.col("review_id") % 3 == 0)
    new = RD.line_manifest(read(), known)
    both = known.withColumn("state", F.lit("known")).unionByName(new.withColumn("state", F.lit("new")))
    category = F.regexp_extract("file_name", r"category=([^/]+)", 1)
    return both.groupBy("state", category.alias("category")).agg(F.sum("n_rows").cast("bigint").alias("n_rows"))


@register(
    "train_test_shards",
    with_ctes(REVIEW_TEXTS)
    + f""", n AS (SELECT category, {_VSTR} AS verified_purchase, count(*) AS c FROM review_texts GROUP BY 1, 2)
  SELECT category, verified_purchase, 'train' AS split, CAST(floor(c * 0.8) AS BIGINT) AS n_rows FROM n WHERE floor(c * 0.8) > 0
  UNION ALL SELECT category, verified_purchase, 'test', c - CAST(floor(c * 0.8) AS BIGINT) FROM n""",
)
def train_test_shards(spark, sf):
    """SPL-1 + SNK-1: four shards per category (train and test, verified and not), written and counted by path."""
    split = S.stratified_split(scored_records(spark, sf), ["category", "verified_purchase"], ["review_id"], 0.8)
    path = scratch_path(spark, "split-shards")
    SK.write_partitioned(split, path, fmt="json")
    m = RD.line_manifest(RD.read_reviews_jsonl(spark, path, scored=True).select("_metadata"))
    part = lambda c: F.regexp_extract("file_name", rf"{c}=([^/]+)", 1).alias(c)
    return m.groupBy(part("category"), part("verified_purchase"), part("split")).agg(F.sum("n_rows").cast("bigint").alias("n_rows"))


@register(
    "product_stats_csv",
    PRODUCT_CTES + " SELECT s.*, m.topic FROM stats s LEFT JOIN modes m USING (asin)",
)
def product_stats_csv(spark, sf):
    """SNK-4: product statistics written as CSV and read back with the written schema."""
    stats = product_stats_df(spark, sf)
    path = scratch_path(spark, "product-stats")
    SK.write_results(stats, path, fmt="csv")
    return spark.read.schema(stats.schema).option("header", True).option("escape", '"').csv(path)


LANDED_FILE_BYTES = 256 << 20  # text of a landed file, about


def landed_files(rec, most: int = LANDED_FILE_BYTES) -> int:
    """Files of a landing: four, and more where a file, and the task that writes it, would hold over ``most`` bytes of text."""
    size = rec.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))).first()[0] or 0
    return max(4, -(-size // most))


def _land_stream_source(spark, sf, cond=None, name="stream-src", path=None):
    rec = scored_records(spark, sf)
    if cond is not None:
        rec = rec.filter(cond)
    path = path or scratch_path(spark, name)
    # several files per landing so that maxFilesPerTrigger cuts real chunks
    SK.write_scored(rec.repartition(landed_files(rec), "review_id"), path, mode="append")
    return path


_STREAM_ORACLE = (
    with_ctes(REVIEW_TEXTS)
    + " SELECT review_id, category, CAST(rating AS VARCHAR) AS rating, predict_stars, verified_purchase FROM review_texts"
)


@register("stream_ingest", _STREAM_ORACLE)
def stream_ingest_q(spark, sf):
    """STR-1 / SNK-2: drain JSONL files in 1-file micro-batches into per-batch Parquet; equals the batch read."""
    src = _land_stream_source(spark, sf)
    dst, ck = scratch_path(spark, "stream-dst"), scratch_path(spark, "stream-ckpt")
    stream_ingest(spark, src, dst, ck, schema=scored_records(spark, sf).schema, max_files=1)
    return spark.read.parquet(dst).select("review_id", "category", "rating", "predict_stars", "verified_purchase")


def _resume_run(spark, sf):
    schema = scored_records(spark, sf).schema
    src = _land_stream_source(spark, sf, F.col("review_id") % 2 == 0, "resume-src")
    dst, ck, st = scratch_path(spark, "resume-dst"), scratch_path(spark, "resume-ckpt"), scratch_path(spark, "resume-status")
    q1 = stream_ingest(spark, src, dst, ck, status=st, schema=schema, max_files=2)
    _land_stream_source(spark, sf, F.col("review_id") % 2 == 1, path=src)  # new files arrive
    q2 = stream_ingest(spark, src, dst, ck, status=st, schema=schema, max_files=2)
    q3 = stream_ingest(spark, src, dst, ck, status=st, schema=schema, max_files=2)  # nothing new: adds 0 rows
    return dst, st, (q1, q2, q3)


@register(
    "stream_resume",
    with_ctes(REVIEW_TEXTS)
    + " SELECT category, count(*) AS n_rows, count(DISTINCT review_id) AS n_ids FROM review_texts GROUP BY category",
)
def stream_resume(spark, sf):
    """STR-2 / STR-3: half the files, then the rest, then a re-run — every row exactly once."""
    dst, _, _ = _resume_run(spark, sf)
    d = spark.read.parquet(dst)
    return d.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("review_id").alias("n_ids"))


@register(
    "file_status",
    with_ctes(REVIEW_TEXTS)
    + " SELECT CASE WHEN review_id % 3 = 2 THEN 'pending' ELSE 'done' END AS status, count(*) AS n_rows"
    " FROM review_texts GROUP BY 1",
)
def file_status(spark, sf):
    """STR-3 / JON-4: per-file status written by the stream; files landed after the last run are pending
    (anti-join of the listed files against the status table)."""
    schema = scored_records(spark, sf).schema
    src = _land_stream_source(spark, sf, F.col("review_id") % 3 == 0, "status-src")
    dst, ck, st = scratch_path(spark, "status-dst"), scratch_path(spark, "status-ckpt"), scratch_path(spark, "status")
    stream_ingest(spark, src, dst, ck, status=st, schema=schema, max_files=2)
    _land_stream_source(spark, sf, F.col("review_id") % 3 == 1, path=src)
    stream_ingest(spark, src, dst, ck, status=st, schema=schema, max_files=2)
    _land_stream_source(spark, sf, F.col("review_id") % 3 == 2, path=src)  # arrives after the last run
    return _status(spark, src, st, schema).groupBy("status").agg(F.sum("n_rows").cast("bigint").alias("n_rows"))


def _status(spark, src, st, schema):
    listed = (
        spark.read.schema(schema).json(src)
        .select(F.col("_metadata.file_path").alias("source_file"))
        .groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"))
    )
    done = spark.read.parquet(st).select("source_file", "n_rows", "status")
    pending = unseen_files(listed, done, "source_file").withColumn("status", F.lit("pending"))
    return done.unionByName(pending)


@register(
    "file_status_partitioned",
    with_ctes(REVIEW_TEXTS)
    + " SELECT CASE WHEN review_id % 2 = 1 THEN 'pending' ELSE 'done' END AS status, category, count(*) AS n_rows FROM review_texts GROUP BY 1, 2",
)
def file_status_partitioned(spark, sf):
    """STR-3 / JON-4 over partition folders in which one write gives all files the same name: files are known by their path."""
    schema = scored_records(spark, sf).schema
    src = scratch_path(spark, "part-status-src")
    rec = scored_records(spark, sf)
    land = lambda cond: rec.filter(cond).write.mode("append").partitionBy("category").json(src)
    dst, ck, st = scratch_path(spark, "part-status-dst"), scratch_path(spark, "part-status-ckpt"), scratch_path(spark, "part-status")
    land(F.col("review_id") % 2 == 0)
    stream_ingest(spark, src, dst, ck, status=st, schema=schema, max_files=1)
    land(F.col("review_id") % 2 == 1)
    category = F.regexp_extract("source_file", r"category=([^/]+)", 1)
    return _status(spark, src, st, schema).groupBy("status", category.alias("category")).agg(F.sum("n_rows").cast("bigint").alias("n_rows"))


@register("stream_metrics", with_ctes(REVIEW_TEXTS) + " SELECT count(*) AS num_input_rows, true AS several_batches, true AS timed FROM review_texts")
def stream_metrics(spark, sf):
    """STR-4: rows and throughput of every micro-batch, from the written metrics table; input rows add up to the table's rows."""
    src = _land_stream_source(spark, sf)
    dst, ck = scratch_path(spark, "metrics-dst"), scratch_path(spark, "metrics-ckpt")
    stream_ingest(spark, src, dst, ck, schema=scored_records(spark, sf).schema, max_files=1)
    m = job_metrics(spark, dst + "_status")
    return m.agg(
        F.sum("num_input_rows").alias("num_input_rows"), (F.count_distinct("batch_id") > 1).alias("several_batches"),
        F.coalesce(F.min((F.col("processed_rows_per_second") > 0) & (F.col("duration_ms") >= 0)), F.lit(False)).alias("timed"),
    )


@register(
    "review_key",
    with_ctes(REVIEW_TEXTS)
    + " SELECT asin, count(*) + 2 * count_if(review_id % 5 = 0) AS n_rows, count(*) + 2 * count_if(review_id % 5 = 0) AS n_keys FROM review_texts GROUP BY asin",
)
def review_key(spark, sf):
    """A key for raw reviews that have none: every fifth one is there three times, and each copy has a key of its own."""
    raw = scored_records(spark, sf).drop("review_id", "category", "predict_stars")
    fifth = scored_records(spark, sf).where(F.col("review_id") % 5 == 0).drop("review_id", "category", "predict_stars")
    keyed = with_review_key(raw.unionByName(fifth).unionByName(fifth))
    return keyed.groupBy("asin").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("review_id").alias("n_keys"))


@register(
    "stream_monthly_trend",
    with_ctes(REVIEW_TEXTS)
    + """ SELECT last_day(make_timestamp(timestamp * 1000)) AS month,
         CASE WHEN verified_purchase THEN 'Verified' ELSE 'Unverified' END AS verification,
         count(*) AS n_reviews,
         CAST(sum(CAST(coalesce(abs(predict_stars - rating) >= 2, false) AS INT)) AS BIGINT) AS misleading_count
  FROM review_texts WHERE timestamp IS NOT NULL AND verified_purchase IS NOT NULL GROUP BY 1, 2""",
)
def stream_monthly_trend_q(spark, sf):
    """AGG-10 as a stateful stream: monthly misleading counts per verification, resumed across two landings."""
    schema = scored_records(spark, sf).schema
    src = _land_stream_source(spark, sf, F.col("review_id") % 2 == 0, "trend-src")
    dst, ck = scratch_path(spark, "trend-dst"), scratch_path(spark, "trend-ckpt")
    stream_monthly_trend(spark, src, dst, ck, schema=schema, max_files=2)
    _land_stream_source(spark, sf, F.col("review_id") % 2 == 1, path=src)
    stream_monthly_trend(spark, src, dst, ck, schema=schema, max_files=2)  # resumes from the state store
    return read_latest(spark, dst)

