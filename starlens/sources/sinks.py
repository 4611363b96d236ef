"""Review sinks.  Re-runs overwrite (partition-wise) instead of appending duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from starlens.sources.schema import PROJECTED_COLUMNS


def write_partitioned(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = ("category", "split", "verified_purchase"),
) -> None:
    """Shard by partition columns; only the partitions present in ``df`` are replaced on re-run."""
    cols = [c for c in partition_by if c in df.columns]
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*cols)
        .format(fmt)
        .save(path)
    )


def write_scored(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Scored records as JSON lines (``mode="append"`` lands new files next to earlier ones)."""
    df.write.mode(mode).json(path)


def write_projection_csv(df: DataFrame, path: str) -> None:
    (
        df.select(*PROJECTED_COLUMNS)
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    opts = (
        {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
        if fmt == "csv"
        else {}
    )
    df.write.mode("overwrite").options(**opts).format(fmt).save(path)
