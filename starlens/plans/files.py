"""Queries over landed files by the position of their lines: numbers, heads, caps, chunk-wise splits, resumption, row-bounded streams, CSV splits.

The reviews are landed as JSON lines in eight shards (folders of part files), each in the order of ``review_id``, so that SQL can state every position.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.plans.fixtures_sql import REVIEW_TEXTS, with_ctes, word_count_sql
from starlens.plans.io import _na, scored_records
from starlens.plans.registry import register
from starlens.session import scratch_path
from starlens.sources import positions as P
from starlens.sources import readers as RD
from starlens.sources import sinks as SK
from starlens.sources.schema import PROJECTED_REVIEW
from starlens.sources.tables import review_texts
from starlens.streaming.rows import ingest_rows

SHARDS, HEAD, CAP, CHUNK, STOP, BATCH = 8, 100, 60, 50, 40, 200
TOGETHER = 500  # batches of a trigger, at most

_NUMBERED = with_ctes(
    REVIEW_TEXTS,
    f"lines AS (SELECT *, review_id % {SHARDS} AS shard, row_number() OVER (PARTITION BY review_id % {SHARDS} ORDER BY review_id) - 1 AS line_no FROM review_texts)",
)


def _land(spark, sf, shards=SHARDS):
    """JSON lines in one folder per shard; its part files follow each other in the order of ``review_id``."""
    path = scratch_path(spark, "numbered-shards")
    rec = scored_records(spark, sf).withColumn("shard", F.col("review_id") % shards)
    rec.repartitionByRange("review_id").sortWithinPartitions("shard", "review_id").write.partitionBy("shard").json(path)
    return path


def _lines(spark, sf):
    shard = F.regexp_extract("source_file", r"shard=(\d+)", 1)
    n = P.numbered_lines(spark, _land(spark, sf), source=shard)
    field = lambda c, t="long": F.get_json_object("value", f"$.{c}").cast(t).alias(c)
    return n.select("source", "line_no", field("review_id"), field("predict_stars", "int"), field("verified_purchase", "boolean"), F.col("source").cast("long").alias("shard"))


@register("file_line_numbers", _NUMBERED + " SELECT review_id, shard, line_no FROM lines")
def file_line_numbers(spark, sf):
    """SRC-9: every line's number in its shard, counted over blocks and part files."""
    return _lines(spark, sf).select("review_id", "shard", "line_no")


@register(
    "head_negative_lines",
    _NUMBERED + f" SELECT review_id, shard, line_no FROM lines WHERE predict_stars < 3 ORDER BY CAST(shard AS VARCHAR), line_no LIMIT {HEAD}",
)
def head_negative_lines(spark, sf):
    """SMP-2 in file order: the first negative reviews by shard and line."""
    return P.head_rows(_lines(spark, sf).where("predict_stars < 3"), HEAD).select("review_id", "shard", "line_no")


@register("cap_lines", _NUMBERED + f" SELECT review_id, shard FROM lines WHERE line_no < {CAP}")
def cap_lines(spark, sf):
    """CAP-1 in file order: the first lines of every shard."""
    return P.head_lines(_lines(spark, sf), CAP).select("review_id", "shard")


@register(
    "split_by_chunk",
    _NUMBERED
    + f""", c AS (SELECT *, line_no // {CHUNK} AS chunk FROM lines),
  o AS (SELECT *, row_number() OVER (PARTITION BY shard, chunk, verified_purchase ORDER BY md5('42|' || review_id), review_id) AS i,
          count(*) OVER (PARTITION BY shard, chunk, verified_purchase) AS n FROM c)
  SELECT review_id, shard, chunk, CASE WHEN i <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM o""",
)
def split_by_chunk(spark, sf):
    """SPL-1 as the files are read: each chunk of a shard's lines is split 80/20 per verification on its own."""
    s = P.chunk_split(_lines(spark, sf), ["verified_purchase"], ["review_id"], chunk_rows=CHUNK)
    return s.select("review_id", "shard", "chunk", "split")


@register(
    "resume_by_line",
    _NUMBERED + f" SELECT review_id, shard, CASE WHEN line_no < {STOP} THEN 1 WHEN line_no < {2 * STOP} THEN 2 ELSE 3 END AS run FROM lines",
)
def resume_by_line(spark, sf):
    """STR-2 within files: two runs of so many lines a shard, then the rest; each goes on behind the lines that are done."""
    lines = _lines(spark, sf)
    none = lines.select("source", F.col("line_no").alias("done")).limit(0)
    one = P.resume_lines(lines, none, STOP)
    two = P.resume_lines(lines, P.lines_done(one), STOP)
    rest = P.resume_lines(lines, P.lines_done(one.unionByName(two)))
    runs = [d.select("review_id", "shard", F.lit(k).alias("run")) for k, d in enumerate((one, two, rest), 1)]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@register("stream_rows", with_ctes(REVIEW_TEXTS) + f" SELECT review_id, CAST((row_number() OVER (ORDER BY review_id) - 1) // {BATCH} AS INT) AS batch_id FROM review_texts")
def stream_rows(spark, sf):
    """STR-1: batches of exactly 200 lines but the last, up to 500 of them a trigger; the query stops after two of them and goes on inside the file."""
    src, dst, ck = _land(spark, sf, 1), scratch_path(spark, "rows-dst"), scratch_path(spark, "rows-ckpt")
    keep = lambda b: b.select(F.get_json_object("value", "$.review_id").cast("long").alias("review_id"), "batch_id")
    ingest_rows(spark, src, dst, ck, BATCH, keep, batches=2, together=TOGETHER)
    ingest_rows(spark, src, dst, ck, BATCH, keep, together=TOGETHER)
    return spark.read.parquet(dst).select("review_id", "batch_id")


@register(
    "csv_split",
    with_ctes(REVIEW_TEXTS)
    + f"""
  SELECT coalesce(helpful_vote, 0) AS helpful_vote, rating, {word_count_sql('text')} AS text_word_length, {_na("coalesce(title, '')")} AS title,
         {_na("coalesce(text, '')")} AS text, timestamp FROM review_texts WHERE rating IS NOT NULL""",
)
def csv_split(spark, sf):
    """SRC-4 by many tasks: the projection CSV, its texts with line breaks, quotes and commas, read back by quote parity over blocks."""
    path = scratch_path(spark, "split-csv")
    SK.write_projection_csv(RD.review_projection(review_texts(spark, sf)), path)
    d = RD.normalise_na(P.read_csv_split(spark, path, PROJECTED_REVIEW))
    return d.select("helpful_vote", "rating", "text_word_length", "title", "text", "timestamp")
