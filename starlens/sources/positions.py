"""Row positions in file order, and CSV files with line breaks in their fields read by many tasks.

Spark reads a large file in blocks, each by one task, in order.  A line's number is therefore the lines of the blocks before its own plus its
place in the block.  The lines are counted per block (map-side), a running sum goes over the blocks of a file (one narrow row each), and the place
in the block comes from the running id of the scan: no window and no sort over lines, and no file is read by a single task.

The same sums find the records of a CSV file.  Whether a byte lies inside quotes depends on the parity of the quotes before it, so the
parity of each block's quotes and a running parity over the blocks tell how every block begins; a line end at even parity ends a record.
Only records of several lines are brought together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlens.session import materialise

CHUNK_ROWS = 10_000  # rows of a chunk of a file


def _blocks(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """Lines with their file, the block they were read in, and a running id within the scan."""
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    lines = reader.text(path)
    meta = [F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block")]
    return lines.select("value", *meta, F.monotonically_increasing_id().alias("_id"))


def numbered_lines(spark: SparkSession, path: str, source: Column | None = None) -> DataFrame:
    """``value``, ``source_file``, ``source`` and ``line_no`` (from 0) of every line under ``path``.

    ``source`` names what is numbered: by default a file.  Where it is a folder (one shard in several part files) the
    lines run on from one file to the next in the order of their paths.  Blank lines count.
    """
    lines = _blocks(spark, path).withColumn("source", F.col("source_file") if source is None else source)
    per_block = lines.groupBy("source", "source_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    upto = F.sum("_n").over(Window.partitionBy("source").orderBy("source_file", "_block"))  # one row a block
    starts = materialise(per_block.withColumn("_before", upto - F.col("_n")).drop("_n"), "line-starts")
    placed = lines.join(starts, ["source", "source_file", "_block"])
    return placed.select("value", "source_file", "source", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line_no"))


def head_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines of every source (a filter on the line number)."""
    return lines.where(F.col("line_no") < n)


def head_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of some rows of numbered lines, in the order of source and line."""
    from starlens.operators.sampling import head_n

    return head_n(rows, n, ["source", "line_no"])


def chunk_split(rows: DataFrame, strata: list[str], keys: list[str], frac: float = 0.8, seed: int = 42, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Stratified split of each chunk of ``chunk_rows`` lines of a source on its own (adds ``chunk`` and ``split``).

    A chunk is bounded, so its strata are ranked by a window; a source of any size is many chunks.
    """
    from starlens.operators.sampling import order_hash

    part = ["source", "chunk", *strata]
    d = rows.withColumn("chunk", F.floor(F.col("line_no") / chunk_rows)).withColumn("_order", order_hash(keys, seed))
    whole = Window.partitionBy(*part)
    rank = F.row_number().over(whole.orderBy("_order", *keys))
    train = rank <= F.floor(F.count(F.lit(1)).over(whole) * F.lit(frac))
    return d.withColumn("split", F.when(train, "train").otherwise("test")).drop("_order")


def lines_done(lines: DataFrame) -> DataFrame:
    """(source, done): how far each source has been read, as a status table keeps it."""
    return lines.groupBy("source").agg((F.max("line_no") + 1).alias("done"))


def resume_lines(lines: DataFrame, done: DataFrame, most: int | None = None) -> DataFrame:
    """The lines behind those that ``done`` (source, done) counts; at most the next ``most`` of each source."""
    begun = lines.join(done, "source", "left").withColumn("_from", F.coalesce("done", F.lit(0)))
    open_ = begun.where(F.col("line_no") >= F.col("_from"))
    if most is not None:
        open_ = open_.where(F.col("line_no") < F.col("_from") + most)
    return open_.select(*lines.columns)


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each line the parity of the block's quotes up to its end (``after``) and the number of line ends of its block before it at
    even and at odd parity.  A task reads its blocks one after the other, so a block's state passes from batch to batch."""
    now, parity, even, odd = None, 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        quotes = pc.count_substring(pc.fill_null(batch.column("value"), ""), '"').to_numpy(zero_copy_only=False).astype(np.int64)
        files, blocks = batch.column("source_file").to_pylist(), batch.column("_block").to_numpy()
        after, evens, odds = (np.empty(batch.num_rows, np.int64) for _ in range(3))
        cuts = [0, *[i for i in range(1, batch.num_rows) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]], batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if (files[a], blocks[a]) != now:
                now, parity, even, odd = (files[a], blocks[a]), 0, 0, 0
            p = (parity + np.cumsum(quotes[a:b])) % 2
            after[a:b] = p
            evens[a:b] = even + np.cumsum(p == 0) - (p == 0)
            odds[a:b] = odd + np.cumsum(p == 1) - (p == 1)
            parity, even, odd = int(p[-1]), int(evens[b - 1] + (p[-1] == 0)), int(odds[b - 1] + (p[-1] == 1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(after), pa.array(evens), pa.array(odds)], [*batch.schema.names, "after", "evens", "odds"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, record_no, record): the records of CSV files whose quotes inside fields are doubled, line breaks in fields kept.

    Records are numbered per file from 0 (the header, where there is one).  Empty lines between records are records.
    """
    lines = _blocks(spark, path, "\n").mapInArrow(
        _parities, "value string, source_file string, _block long, _id long, after long, evens long, odds long"
    )
    lines = materialise(lines, "csv-lines")  # the parity pass runs once
    even = F.col("after") == 0
    per_block = lines.groupBy("source_file", "_block").agg(
        F.max_by("after", "_id").alias("_p"), F.count_if(even).alias("_even"), F.count_if(~even).alias("_odd")
    )
    run = Window.partitionBy("source_file").orderBy("_block")  # one row a block
    starts = per_block.withColumn("_start", (F.sum("_p").over(run) - F.col("_p")) % 2)
    ends = F.when(F.col("_start") == 0, F.col("_even")).otherwise(F.col("_odd"))
    starts = starts.withColumn("_before", F.sum(ends).over(run) - ends).select("source_file", "_block", "_start", "_before")
    at = lines.join(materialise(starts, "csv-starts"), ["source_file", "_block"])
    number = F.col("_before") + F.when(F.col("_start") == 0, F.col("evens")).otherwise(F.col("odds"))
    own = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
    ended = (F.col("after") + F.col("_start")) % 2 == 0
    begun = (F.col("after") + F.col("_start") + own) % 2 == 0  # the parity before the line
    at = at.select("source_file", "_block", "_id", "value", number.alias("record_no"), (begun & ended).alias("_whole"))
    whole = at.where("_whole").select("source_file", "record_no", F.col("value").alias("record"))
    pieces = at.where("not _whole").groupBy("source_file", "record_no").agg(F.sort_array(F.collect_list(F.struct("_block", "_id", "value"))).alias("p"))
    return whole.unionByName(pieces.select("source_file", "record_no", F.array_join("p.value", "\n").alias("record")))


def read_csv_split(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """CSV whose fields may hold line breaks, each file read by many tasks; the rows that ``multiLine`` reading gives."""
    r = csv_records(spark, path)
    r = r.withColumn("record", F.when(F.col("record_no") == 0, F.regexp_replace("record", "^\\x{FEFF}", "")).otherwise(F.col("record")))
    r = r.where("record_no > 0") if header else r
    r = r.withColumn("record", F.regexp_replace("record", "\r$", "")).where("record <> ''")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = F.from_csv("record", columns, {"escape": '"', "multiLine": "true"})
    return r.select(parsed.alias("r")).select("r.*")
