"""A stream of batches of exactly n lines, whose offsets are (file, byte, row).

The source is a Python data source that names ranges of bytes, never lines: for a batch it walks n line ends on from the last offset, and the
executors read the ranges.  So one large file is many batches, a batch may begin in one file and end in the next, and a
restarted query goes on at the byte where the last batch ended.  Files are taken in the order of their paths; later files have to sort behind earlier
ones, and the last file may grow.  A trigger can take several batches (``together``), so that short batches don't cost a trigger each.  Files are opened by ``pyarrow.fs``: local or shared folders, and the stores that it knows by their URI.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from starlens.streaming.ingest import run_id

BATCH_ROWS = 10_000
TASK_ROWS = 2_500  # lines of a range, so that the tasks of a batch share it
READ_BYTES = 1 << 20
RANGE = "file string, start long, stop long, first_row long, batch_id long"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files below a folder, in the order of their paths; hidden ones are left out."""
    store, top = _open(path)
    info = store.get_file_info(fs.FileSelector(top, recursive=True))
    inner = lambda p: p[len(top) :].strip("/").split("/")
    return sorted((i.path, i.size) for i in info if i.type == fs.FileType.File and i.size and not any(x[:1] in "._" for x in inner(i.path)))


def line_end(file, start: int, size: int, rows: int) -> tuple[int, int]:
    """(byte behind the ``rows``-th line from byte ``start``, lines found); a last line without its line break counts."""
    at, found = start, 0
    file.seek(start)
    while at < size:
        part = file.read(min(READ_BYTES, size - at))
        if not part:
            break
        ends = np.flatnonzero(np.frombuffer(part, np.uint8) == 10)
        if found + len(ends) >= rows:
            return at + int(ends[rows - found - 1]) + 1, rows
        found += len(ends)
        at += len(part)
        if at >= size and part[-1:] != b"\n":
            found += 1
    return at, found


def walk(path: str, start: dict, rows: int) -> Iterator[tuple[tuple[str, int, int, int], dict]]:
    """The ranges of the next ``rows`` lines behind an offset, each with the offset of its end."""
    store, _ = _open(path)
    files, left = _files(path), rows
    for name, size in files[bisect.bisect_left(files, (start["file"], 0)) :]:
        byte, row = (start["byte"], start["row"]) if name == start["file"] else (0, 0)
        if byte >= size:
            continue
        with store.open_input_file(name) as f:
            while left and byte < size:
                stop, n = line_end(f, byte, size, min(left, TASK_ROWS))
                if stop == byte:
                    break
                yield (name, byte, stop, row), {"file": name, "byte": stop, "row": row + n}
                byte, row, left = stop, row + n, left - n
        if not left:
            return


class RowRangeReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.path, self.rows, self.batches = options["path"], int(options.get("rows", BATCH_ROWS)), int(options.get("batches", 0))
        self.together = int(options.get("together", 1))
        self.offered = 0

    def initialOffset(self) -> dict:
        return {"file": "", "byte": 0, "row": 0, "batch": 0}

    def following(self, start: dict, most: int) -> Iterator[tuple[tuple[str, int, int, int, int], dict]]:
        """The ranges of up to ``most`` batches behind an offset, each with the offset of its end; a batch that isn't full is the last."""
        for n in range(start.get("batch", 0), start.get("batch", 0) + most):
            lines = 0
            for (name, a, b, row), after in walk(self.path, start, self.rows):
                lines += after["row"] - row
                start = after | {"batch": n + 1}
                yield (name, a, b, row, n), start
            if lines < self.rows:
                return

    def read(self, start: dict):
        if self.together > 1 and "batch" not in start:
            raise ValueError("a checkpoint without numbers of batches can only go on with one batch a trigger")
        most = min(self.together, self.batches - self.offered) if self.batches else self.together
        found = list(self.following(start, most)) if most > 0 else []
        self.offered += len({r[-1] for r, _ in found})
        return iter([r for r, _ in found]), found[-1][1] if found else start

    def readBetweenOffsets(self, start: dict, end: dict):
        """The ranges of a trigger that runs again; the file may have grown since, so the last one ends at ``end``."""
        out = []
        for (name, a, b, row, n), after in self.following(start, self.together):
            past = (after["file"], after["byte"]) >= (end["file"], end["byte"])
            out.append((name, a, end["byte"] if past and name == end["file"] else b, row, n))
            if past:
                break
        return iter(out)


class RowRanges(DataSource):
    """``spark.readStream.format("row_ranges")`` with the options path, rows (of a batch), batches (0: all there are) and together (batches of a trigger)."""

    @classmethod
    def name(cls) -> str:
        return "row_ranges"

    def schema(self) -> str:
        return RANGE

    def simpleStreamReader(self, schema):
        return RowRangeReader(self.options)


def _read_ranges(path: str) -> Callable:
    schema = pa.schema([("value", pa.string()), ("source_file", pa.string()), ("line_no", pa.int64()), ("batch_id", pa.int64())])

    def body(batches):
        store, _ = _open(path)
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(r["file"]) as f:
                    f.seek(r["start"])
                    lines = f.read(r["stop"] - r["start"]).decode("utf-8", "replace").removesuffix("\n").split("\n")
                lines = [x.removesuffix("\r") for x in lines]
                numbers = pa.array(range(r["first_row"], r["first_row"] + len(lines)), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(lines), pa.array([r["file"]] * len(lines)), numbers, pa.array([r["batch_id"]] * len(lines), pa.int64())], schema=schema)

    return body


def row_stream(spark: SparkSession, path: str, rows: int = BATCH_ROWS, batches: int = 0, together: int = 1) -> DataFrame:
    """Lines (value, source_file, line_no) in micro-batches of exactly ``rows`` lines but the last; with ``together`` above 1, micro-batches of up to so
    many of these batches, told apart by a column ``batch_id``."""
    spark.dataSource.register(RowRanges)
    ranges = spark.readStream.format("row_ranges").option("path", path).option("rows", rows).option("batches", batches).option("together", together).load()
    dealt = ranges.repartition(max(1, -(-rows * together // TASK_ROWS)), "file", "start")
    lines = dealt.mapInArrow(_read_ranges(path), "value string, source_file string, line_no long, batch_id long")
    return lines if together > 1 else lines.drop("batch_id")


def ingest_rows(
    spark: SparkSession, src: str, dst: str, checkpoint: str, rows: int = BATCH_ROWS, transform: Callable[[DataFrame], DataFrame] | None = None, batches: int = 0,
    together: int = 1,
):
    """Drains what is under ``src`` into ``dst``, one folder for each batch of ``rows`` lines (overwritten when a batch runs again); returns the query.

    ``batches`` ends the run after so many; the next run goes on behind the last committed one, also inside a file.  With ``together`` above 1 a trigger writes
    up to so many batches' folders in one job; ``transform`` then works row by row and keeps the column ``batch_id``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        run = f"{dst}/run={run_id(batch.sparkSession, checkpoint)}"
        if together > 1:
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(run)
        else:
            out.write.mode("overwrite").parquet(f"{run}/batch_id={batch_id}")

    stream = row_stream(spark, src, rows, batches, together)
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return q


def last_offset(spark: SparkSession, checkpoint: str) -> dict | None:
    """(file, byte, row) behind the last batch that was planned with this checkpoint."""
    logged = spark.read.text(f"{checkpoint}/offsets", wholetext=True).select("value", F.col("_metadata.file_name").cast("int").alias("n"))
    newest = logged.orderBy(F.desc("n")).first()
    return json.loads(newest["value"].strip().split("\n")[-1]) if newest else None
