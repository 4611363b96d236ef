"""Helpers shared by the operators: shuffle sizing, written intermediate tables, Arrow loops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.session import materialise

__all__ = ["arrow_rows", "fresh_name", "materialise", "numbered", "partitions"]


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    """Partitions for an explicit exchange: the session's shuffle partitions, or more when asked."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), at_least)


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet (names compare without case, as in Spark)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def arrow_rows(fn: Callable[..., dict | None], schema: pa.Schema, rows: int = 512) -> Callable:
    """A ``mapInArrow`` body from a per-row function.

    ``fn`` gets the row's values in column order and returns a dict of output values (or None for no row).
    Input batches are cut into ``rows`` rows so that a batch of long texts is not held twice as Python objects.
    """

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = [r for r in map(fn, *[c.to_pylist() for c in part.columns]) if r is not None]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return body


def numbered(docs: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """``columns`` of ``docs`` with a long ``row`` that no two rows share.

    ``row`` is the key itself where every key is set and unique; otherwise the rows are written once with a running
    number in the order of the key (null first), so that later reads and retried tasks see the same one.
    """
    again = docs.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("k").isNull())
    named = [c.alias(n) for n, c in columns.items()]
    if again.isEmpty():
        return docs.select(F.col(key).cast("long").alias("row"), *named)
    return materialise(docs.orderBy(F.col(key).asc_nulls_first()).select(F.monotonically_increasing_id().alias("row"), *named), "numbered")
