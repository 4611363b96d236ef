"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame builder, with its SQL oracle when SQL can state it."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return deco


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One-row results as one row (a few numbers each; no join without a key)."""
    fields = [f for d in frames for f in d.schema.fields]
    row = tuple(v for d in frames for v in d.first())
    return frames[0].sparkSession.createDataFrame([row], T.StructType(fields))
