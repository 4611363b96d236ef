"""Review roll-ups: mismatch rankings, overviews, distributions, monthly trends, rates, crosstabs.

Every roll-up is one hash aggregate with map-side partial aggregation, so a hot product or user (even one
holding a third of all rows) is pre-combined inside each task before the shuffle.  Top-k lists are small
(bounded by ``k``) and are the only thing ever broadcast back into a semi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from starlens.functions import features as X
from starlens.session import materialise as materialise_table

DIGITS = 6


def _flag() -> F.Column:
    return F.col("is_misleading").cast("int")


def mismatch(df: DataFrame, key: str, min_reviews: int, k: int = 10) -> DataFrame:
    """Per key: review count, misleading count and rate (%); keep keys with ≥ min_reviews; top k by count.

    Ties on the misleading count are broken by the key, ascending.
    """
    g = (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("review_count"), F.sum(_flag()).cast("bigint").alias("misleading_count"))
        .filter(F.col("review_count") >= min_reviews)
        .withColumn("misleading_rate_pct", F.round(F.col("misleading_count") * 100.0 / F.col("review_count"), DIGITS))
    )
    return g.orderBy(F.desc("misleading_count"), F.asc(key)).limit(k)


def rows_of(df: DataFrame, top: DataFrame, key: str, only_misleading: bool = False) -> DataFrame:
    """Rows whose key is in ``top`` (a k-row list: broadcast is size-bounded by k)."""
    out = df.join(F.broadcast(top.select(key)), key, "left_semi")
    return out.filter(F.col("is_misleading")) if only_misleading else out


def monthly_trend(rows: DataFrame, keys=(), how: str = "count") -> DataFrame:
    """Per month-end × keys × verification: ``count`` of rows or ``sum`` of the flag. Null times dropped."""
    r = rows.filter(F.col("review_time").isNotNull() & F.col("verified_purchase").isNotNull())
    grp = [X.month_end("review_time").alias("month"), *keys, X.verified_label("verified_purchase").alias("verification")]
    measure = F.count(F.lit(1)) if how == "count" else F.sum(_flag()).cast("bigint")
    return r.groupBy(*grp).agg(measure.alias("misleading_count"))


def rate_by_verified(df: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """For each key in ``top``: misleading % among verified and among unverified rows (absent class → no row)."""
    r = rows_of(df, top, key).filter(F.col("verified_purchase").isNotNull())
    return r.groupBy(key, X.verified_label("verified_purchase").alias("verification")).agg(
        F.round(F.avg(_flag()) * 100.0, DIGITS).alias("misleading_rate_pct")
    )


def rate_pivot(rates: DataFrame, key: str) -> DataFrame:
    """Wide form: key × {Unverified, Verified}, 2 decimals, half-to-even."""
    wide = rates.groupBy(key).pivot("verification", ["Unverified", "Verified"]).agg(F.first("misleading_rate_pct"))
    return wide.select(
        key,
        F.bround("Unverified", 2).alias("unverified_rate_pct"),
        F.bround("Verified", 2).alias("verified_rate_pct"),
    )


def dataset_overview(df: DataFrame) -> DataFrame:
    """Reviews, distinct users / products, verified, unverified (= n − verified), misleading, misleading %."""
    # written once and narrow: each count of distinct values reads files of a fixed size, so what a task holds doesn't grow with the table
    rows = materialise_table(df.select("user_id", "product_id", F.col("verified_purchase").cast("int").alias("verified"), _flag().alias("flag")), "overview-rows")
    g = rows.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.sum("verified").cast("bigint").alias("verified_reviews"),
        F.sum("flag").cast("bigint").alias("misleading_reviews"),
        F.round(F.avg("flag") * 100.0, DIGITS).alias("misleading_pct"),
    )
    for key, name in (("user_id", "distinct_users"), ("product_id", "distinct_products")):
        g = g.withColumn(name, F.lit(rows.select(key).where(F.col(key).isNotNull()).distinct().count()).cast("bigint"))  # one number: no join without a key
    return g.select(
        "total_reviews", "distinct_users", "distinct_products", "verified_reviews", "misleading_reviews", "misleading_pct",
        (F.col("total_reviews") - F.col("verified_reviews")).alias("unverified_reviews"),
    )


def describe_numeric(df: DataFrame, columns) -> DataFrame:
    """count, mean, sample std, min, exact 25/50/75 % (linear interpolation), max of each column, long form.

    Moments and extremes are one aggregate over the plain columns.  For the quartiles the rows are reduced to (column, value, count) and
    ranked over range-partitioned values, so a column with very many distinct values (a timestamp) is in no single task.
    """
    from starlens.operators.quantiles import exact_quantiles

    values = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}  # null stays null
    moments = {"n": F.count, "_mean": F.avg, "_std": F.stddev_samp, "min_value": F.min, "max_value": F.max}
    one = df.agg(*[F.struct(F.lit(c).alias("column_name"), *[fn(v).alias(m) for m, fn in moments.items()]).alias(f"_{i}") for i, (c, v) in enumerate(values.items())])
    first = one.select(F.inline(F.array(*[f"_{i}" for i in range(len(values))])))  # one row a column, those without values too
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), v.alias("value")) for c, v in values.items()])
    counts = df.select(F.inline(pairs)).where("value is not null").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    q = exact_quantiles(counts, "column_name", (0.25, 0.5, 0.75)).drop("n")
    return first.join(q, "column_name", "left").select(
        "column_name",
        "n",
        F.round("_mean", DIGITS).alias("mean"),
        F.round("_std", DIGITS).alias("std"),
        "min_value",
        *[F.round(F.col("q")[i], DIGITS).alias(f"p{p}") for i, p in enumerate((25, 50, 75))],
        "max_value",
    )


def null_counts(df: DataFrame, columns=None) -> DataFrame:
    cols = columns or df.columns
    arr = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("null_count")) for c in cols]
    )
    return df.agg(arr.alias("s")).select(F.inline("s"))


def value_distribution(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Rows per non-null value of ``col``."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(F.col(col).alias(name or col))
        .agg(F.count(F.lit(1)).alias("n_reviews"))
    )


def topic_counts(df: DataFrame, topic: str = "topic") -> DataFrame:
    """Reviews per topic and their share.  The share window runs over the aggregated table (one row per topic)."""
    per = df.filter(F.col(topic).isNotNull()).groupBy(topic).agg(F.count(F.lit(1)).alias("n_reviews"))
    total = F.sum("n_reviews").over(Window.partitionBy())
    return per.select(topic, "n_reviews", F.round(F.col("n_reviews") / total, DIGITS).alias("share"))


def topic_rating_diff(df: DataFrame, topic: str = "topic") -> DataFrame:
    return (
        df.filter(F.col(topic).isNotNull())
        .groupBy(topic)
        .agg(F.round(F.avg("rating_diff"), DIGITS).alias("avg_rating_diff"), F.count("rating_diff").alias("review_count"))
    )


def crosstab_pct(df: DataFrame, row: str, col: str, values, names) -> DataFrame:
    """Row-normalised % of ``col`` values per ``row`` (null cells skipped; every value column present).

    Null cells are skipped by counting (``count(col)``, ``count_if``) rather than by a filter on ``col``:
    a predicate on a derived column would be pushed below the projection and re-evaluate the derivation
    (e.g. a regex word count) once per reference.
    """
    counts = [F.count_if(F.col(col) == F.lit(v)).alias(f"_c{i}") for i, v in enumerate(values)]
    g = (
        df.filter(F.col(row).isNotNull())
        .groupBy(row)
        .agg(F.count(col).alias("_n"), *counts)
        .filter(F.col("_n") > 0)
    )
    return g.select(
        row, *[F.round(F.col(f"_c{i}") * 100.0 / F.col("_n"), DIGITS).alias(n) for i, n in enumerate(names)]
    )


def group_misleading_rate(df: DataFrame, topic_id: int | None, topic: str = "topic", threshold: int = 50) -> DataFrame:
    """Within one topic: misleading % and count per (Long/Short) × (Verified/Unverified) group."""
    d = df if topic_id is None else df.filter(F.col(topic) == topic_id)
    grp = X.group_label(X.length_bucket2("review_words", threshold), "verified_purchase")
    return d.groupBy(grp.alias("review_group")).agg(
        F.round(F.avg(_flag()) * 100.0, DIGITS).alias("misleading_rate_pct"), F.count(F.lit(1)).alias("review_count")
    )


# ----------------------------------------------------------------- one-pass report cube
#
# The trend and rate reports need the top-k keys first and then those keys' rows: two passes over the
# raw data.  Instead, one pass builds a cube (key, month, verification) → (rows, misleading rows); the
# top-k ranking, the monthly trends and the per-verification rates are all re-aggregations of that much
# smaller table.  The cube is materialised as a written table in the shared checkpoint folder: without
# it Catalyst pushes each branch's filters and the semi-join below the aggregate, the branches differ and
# the raw data would be scanned and joined twice.  The written table also cuts the lineage for retries.

def key_cube(df: DataFrame, key: str, materialise: bool = True) -> DataFrame:
    cube = (
        df.filter(F.col(key).isNotNull())
        .groupBy(
            key,
            X.month_end("review_time").alias("month"),
            F.col("verified_purchase").alias("_v"),
        )
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(_flag()).cast("bigint").alias("_m"))
    )
    return materialise_table(cube, f"cube-{key}") if materialise else cube


def top_from_cube(cube: DataFrame, key: str, min_reviews: int, k: int = 10) -> DataFrame:
    g = (
        cube.groupBy(key)
        .agg(F.sum("_n").cast("bigint").alias("review_count"), F.sum("_m").cast("bigint").alias("misleading_count"))
        .filter(F.col("review_count") >= min_reviews)
        .withColumn("misleading_rate_pct", F.round(F.col("misleading_count") * 100.0 / F.col("review_count"), DIGITS))
    )
    return g.orderBy(F.desc("misleading_count"), F.asc(key)).limit(k)


def cube_of_top(cube: DataFrame, key: str, min_reviews: int, k: int = 10) -> DataFrame:
    top = top_from_cube(cube, key, min_reviews, k)
    return cube.join(F.broadcast(top.select(key)), key, "left_semi")


def trend_from_cube(cube_top: DataFrame, keys=(), how: str = "count") -> DataFrame:
    """AGG-10 (``count`` of misleading rows) / AGG-11 (``sum`` of the flag, zero groups kept)."""
    c = cube_top.filter(F.col("month").isNotNull() & F.col("_v").isNotNull())
    if how == "count":
        c = c.filter(F.col("_m") > 0)
    g = c.groupBy("month", *keys, X.verified_label("_v").alias("verification")).agg(
        F.sum("_m").cast("bigint").alias("misleading_count")
    )
    return g


def rate_from_cube(cube_top: DataFrame, key: str) -> DataFrame:
    c = cube_top.filter(F.col("_v").isNotNull())
    return c.groupBy(key, X.verified_label("_v").alias("verification")).agg(
        F.round(F.sum("_m") * 100.0 / F.sum("_n"), DIGITS).alias("misleading_rate_pct")
    )
