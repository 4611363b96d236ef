"""Structured Streaming ingestion and scoring: chunked, resumable, exactly-once in effect.

* The file source lists new files only; a batch takes files up to a number of bytes (or files), and the checkpoint's source log
  remembers which files were taken, so a re-run picks up exactly the files that arrived since.  Files are known by their full path.
* ``foreachBatch`` writes each micro-batch to its own ``run=R/batch_id=N`` folder with overwrite, so a retried batch (executor lost,
  driver restarted) replaces its own output instead of appending duplicates.  ``R`` is the checkpoint's own id: a fresh
  checkpoint starts batches at 0 again and does not touch what an earlier one wrote.
* Beside the output go a per-file status table (file, rows, status) and a metrics table with one row per batch, written the same way.
* ``trigger(availableNow=True)`` drains what is there in bounded batches and stops.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlens.sources.schema import SCORED_REVIEW

BATCH_BYTES = 1 << 30  # input of a micro-batch; at least one file


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query when it first used this checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def _limits(reader, max_bytes: int | None, max_files: int | None):
    if max_files:
        return reader.option("maxFilesPerTrigger", max_files)
    return reader.option("maxBytesPerTrigger", max_bytes or BATCH_BYTES)


def _batch_writer(dst: str, status: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None, fmt: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, began = batch.sparkSession, time.time()
        part = f"run={run_id(spark, checkpoint)}/batch_id={batch_id}"
        batch = batch.persist()  # read by the transformation and by the status
        try:
            out = transform(batch) if transform else batch
            out.write.mode("overwrite").format(fmt).save(f"{dst}/{part}")
            done = batch.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("status", F.lit("done"))
            done.write.mode("overwrite").parquet(f"{status}/{part}")
            seconds = time.time() - began
            n = F.coalesce(F.sum("n_rows"), F.lit(0))
            row = spark.read.parquet(f"{status}/{part}").agg(n.cast("bigint").alias("num_input_rows"))
            row = row.withColumn("duration_ms", F.lit(int(1000 * seconds)).cast("bigint"))
            row.withColumn("processed_rows_per_second", F.col("num_input_rows") / F.lit(max(seconds, 1e-3))).write.mode("overwrite").parquet(f"{status}_metrics/{part}")
        finally:
            batch.unpersist()

    return write


def stream_ingest(
    spark: SparkSession,
    src: str,
    dst: str,
    checkpoint: str,
    status: str | None = None,
    schema: T.StructType = SCORED_REVIEW,
    max_bytes: int | None = None,
    max_files: int | None = None,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    fmt: str = "json",
    out_fmt: str = "parquet",
):
    """Drain new files under ``src`` into ``dst`` (one folder per micro-batch); returns the query.

    ``status`` (default ``dst`` + "_status") gets the file status, ``status`` + "_metrics" the batch metrics.
    """
    reader = spark.readStream.format(fmt)
    reader = reader if fmt == "text" else reader.schema(schema)
    stream = _limits(reader, max_bytes, max_files).load(src)
    stream = stream.withColumn("source_file", F.col("_metadata.file_path"))
    q = (
        stream.writeStream.foreachBatch(_batch_writer(dst, status or dst + "_status", checkpoint, transform, out_fmt))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q


def stream_score(
    spark: SparkSession,
    src: str,
    dst: str,
    checkpoint: str,
    scorer: Callable[[DataFrame], DataFrame],
    status: str | None = None,
    max_bytes: int | None = None,
    max_files: int | None = None,
):
    """The scoring job: review JSON lines in, the same records with ``predict_stars`` and ``predict_status`` out.

    Title and text are scored together.  Lines that are no review are left out of the output (``read_reviews_tolerant`` reports them).  A
    re-run takes up after the last finished batch.
    """
    from starlens.functions.text import merge_text
    from starlens.operators.prepare import with_review_key
    from starlens.operators.sentiment import predict_stars
    from starlens.sources.readers import parse_reviews

    def score(batch: DataFrame) -> DataFrame:
        good = parse_reviews(batch, scored=False).where("reject_reason is null").drop("reject_reason", "value", "source_file")
        keyed = with_review_key(good, "_review_key").withColumn("_full", merge_text("title", "text", ". ", strip=True))
        return predict_stars(keyed, scorer, "_review_key", "_full").drop("_review_key", "_full")

    return stream_ingest(spark, src, dst, checkpoint, status, max_bytes=max_bytes, max_files=max_files, transform=score, fmt="text", out_fmt="json")


def job_metrics(spark: SparkSession, status: str) -> DataFrame:
    """(run, batch_id, num_input_rows, processed_rows_per_second, duration_ms) of every batch written with this status path."""
    return spark.read.parquet(f"{status}_metrics").select("run", "batch_id", "num_input_rows", "processed_rows_per_second", "duration_ms")


def unseen_files(files: DataFrame, manifest: DataFrame, key: str = "file_name") -> DataFrame:
    """Files not yet in the manifest / status table (anti-join on the file's path)."""
    return files.join(manifest.select(key), key, "left_anti")


def write_version(df: DataFrame, dst: str, version: int, run: str = "0") -> None:
    """A complete result as version N of a run beside earlier ones; the pointer row is written after it, so readers never see part of one.

    A fresh checkpoint is another run and starts its versions at 0 again, so the pointer names the run and when it was written.
    """
    df.write.mode("overwrite").parquet(f"{dst}/run={run}/version={version}")
    row = df.sparkSession.range(1).select(F.lit(time.time_ns()).alias("written"))
    row.write.mode("overwrite").parquet(f"{dst}_pointer/run={run}/version={version}")


def read_latest(spark: SparkSession, dst: str) -> DataFrame:
    """The complete version that was written last."""
    newest = spark.read.schema("written long, run string, version long").parquet(f"{dst}_pointer").orderBy(F.desc("written")).first()
    return spark.read.parquet(f"{dst}/run={newest['run']}/version={newest['version']}")


def stream_monthly_trend(
    spark: SparkSession,
    src: str,
    dst: str,
    checkpoint: str,
    schema: T.StructType = SCORED_REVIEW,
    max_bytes: int | None = None,
    max_files: int | None = None,
    watermark: str = "62 days",
):
    """AGG-10 on a stream: misleading and total reviews per month-end × verification; read it with ``read_latest``.

    A stateful streaming aggregate (state in the checkpoint's state store, so a restarted query resumes
    from its last committed batch).  State is one row per (month, verification) — bounded by the number of
    months, not by the data — so ``complete`` output is safe; in complete mode Spark keeps all state and
    the declared watermark drops nothing (it only takes effect if the query is run in update mode).
    Each micro-batch writes the complete current result as a new version; a retried batch rewrites its own.
    """
    from starlens.functions import features as X

    s = (
        _limits(spark.readStream.schema(schema), max_bytes, max_files)
        .json(src)
        .withColumn("review_time", X.epoch_ms("timestamp").cast("timestamp"))  # event time must be TIMESTAMP
        .withColumn("is_misleading", X.misleading("predict_stars", X.to_int("rating")))
        .filter(F.col("review_time").isNotNull() & F.col("verified_purchase").isNotNull())
        .withWatermark("review_time", watermark)
    )
    agg = s.groupBy(
        X.month_end("review_time").alias("month"), X.verified_label("verified_purchase").alias("verification")
    ).agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.sum(F.col("is_misleading").cast("int")).cast("bigint").alias("misleading_count"),
    )
    q = (
        agg.writeStream.outputMode("complete")
        .foreachBatch(lambda batch, batch_id: write_version(batch, dst, batch_id, run_id(batch.sparkSession, checkpoint)))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q
