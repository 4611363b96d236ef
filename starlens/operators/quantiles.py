"""Exact quantiles of many groups from (group, value, count) rows, with no group gathered in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlens.session import materialise


def exact_quantiles(counts: DataFrame, by: str, probs: Sequence[float]) -> DataFrame:
    """(by, value, n) rows, each (by, value) once -> (by, n, q: array of linearly interpolated quantiles).

    Values are range-partitioned by (by, value) and written; a partition's offset within its group is a running sum over the
    partitions; the values at the needed ranks are the rows whose interval of ranks holds one.
    """
    order = [F.col(by).asc_nulls_first(), F.col("value")]
    placed = counts.select(by, "value", "n").repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    placed = materialise(placed, "quantile-order")
    parts = placed.groupBy(by, "_p").agg(F.sum("n").alias("_c"))
    whole = Window.partitionBy(by)
    parts = parts.select(
        F.col(by).alias("_by"),
        F.col("_p").alias("_q"),
        (F.sum("_c").over(whole.orderBy("_p")) - F.col("_c")).alias("_offset"),
        F.sum("_c").over(whole).alias("_total"),
    )
    j = placed.join(parts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_p") == F.col("_q")))
    upto = F.col("_offset") + F.sum("n").over(Window.partitionBy(by, "_p").orderBy("value"))
    j = j.withColumn("_upto", upto)
    rank = [(F.col("_total") - 1) * F.lit(float(p)) for p in probs]
    wanted = F.array(*[x.cast("long") for r in rank for x in (F.floor(r), F.ceil(r))])
    held = F.filter(F.transform(wanted, lambda r, i: F.struct(r.alias("rank"), i.alias("i"))), lambda s: (s["rank"] >= F.col("_upto") - F.col("n")) & (s["rank"] < F.col("_upto")))
    hit = j.select(by, "_total", "value", F.explode(held).alias("s")).select(by, "_total", "s.i", "value")
    ends = hit.groupBy(by, "_total").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("v"))  # two values a quantile

    def between(k, p):
        lo, hi = F.col("v")[2 * k]["value"], F.col("v")[2 * k + 1]["value"]
        r = (F.col("_total") - 1) * F.lit(float(p))
        return lo + (hi - lo) * (r - F.floor(r))

    return ends.select(by, F.col("_total").alias("n"), F.array(*[between(k, p) for k, p in enumerate(probs)]).alias("q"))
