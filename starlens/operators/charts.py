"""The numbers behind histograms, density curves and box plots (drawing is left to the caller).

* histogram: one pass reduces rows to (value, count); range and bins come from that table; every bin is reported, empty ones as 0.
* KDE: values are first reduced to (group, value, count) in the only pass over the rows — cost follows
  distinct values, not rows; the bandwidth statistics come from that table, and each distinct value then
  contributes to the fixed grid in-row and a partial aggregate sums per grid point.
  Grid size is a parameter, so the work is linear in the data (no value × value pairs).
* box plot: one pass reduces rows to (group, value, count); exact quartiles come from it by rank, then whiskers and outlier
  counts from the same table against the one-row-per-group statistics.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.operators.quantiles import exact_quantiles

DIGITS = 6
MOMENTS = 5  # of the offsets in a bin of a binned density


def _group_side(stats: DataFrame, name: str) -> DataFrame:
    """One row per group, written once; its file size decides between a broadcast and a shuffle join."""
    from starlens.session import materialise

    return materialise(stats, name)


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """(bin 1..bins, bin_lo, bin_hi, n): equal-width bins over [min, max]; the max falls in the last bin."""
    from starlens.session import materialise

    spark = df.sparkSession
    x = F.col("_x")
    # the only pass over the rows: (value, count), written once
    vals = materialise(df.select(F.col(col).cast("double").alias("_x")).where(x.isNotNull()).groupBy("_x").agg(F.count(F.lit(1)).alias("_c")), "histogram-values")
    lo, hi = vals.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_lo double, bin_hi double, n bigint")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((x - F.lit(lo)) * bins / F.lit(hi - lo if hi > lo else 1.0)) + 1, F.lit(bins)).cast("int")
    counts = vals.groupBy(b.alias("bin")).agg(F.sum("_c").alias("n"))
    grid = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    out = grid.join(counts, "bin", "left")
    return out.select(
        "bin",
        F.round(F.lit(lo) + (F.col("bin") - 1) * F.lit(width), DIGITS).alias("bin_lo"),
        F.round(F.lit(lo) + F.col("bin") * F.lit(width), DIGITS).alias("bin_hi"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
    )


def kde(df: DataFrame, col: str, by: str, grid: int = 200, cut: float = 3.0) -> DataFrame:
    """(group, point 0..grid-1, x, density): Gaussian KDE with Scott's bandwidth h = std · n^(-1/5).

    The grid spans [min − cut·h, max + cut·h].  Groups with fewer than 2 values or zero spread emit nothing.
    """
    from starlens.session import materialise

    x = F.col(col).cast("double")
    d = df.filter(x.isNotNull() & F.col(by).isNotNull())
    # the only pass over the rows: (group, value, count), written once; everything else reads it
    vals = materialise(d.groupBy(by, x.alias("_x")).agg(F.count(F.lit(1)).alias("_c")), "kde-values")
    c, v = F.col("_c"), F.col("_x")
    first = vals.groupBy(by).agg(
        F.sum(c).alias("_n"), (F.sum(c * v) / F.sum(c)).alias("_mu"), F.min(v).alias("_lo"), F.max(v).alias("_hi")
    )
    # sample standard deviation from centred squares (two steps over the small table, not sum-of-squares)
    moments = vals.join(first, by).groupBy(by, "_n", "_lo", "_hi").agg(
        F.sum(c * (v - F.col("_mu")) * (v - F.col("_mu"))).alias("_ss")
    )
    stats = (
        moments.withColumn("_sd", F.sqrt(F.col("_ss") / (F.col("_n") - 1)))
        .filter((F.col("_n") >= 2) & (F.col("_sd") > 0))
        .withColumn("_h", F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2)))
        .withColumn("_g0", F.col("_lo") - cut * F.col("_h"))
        .withColumn("_step", (F.col("_hi") - F.col("_lo") + 2 * cut * F.col("_h")) / F.lit(grid - 1))
    )
    stats = _group_side(stats, "kde-groups")
    j = vals.join(stats, by)
    norm = 1.0 / math.sqrt(2 * math.pi)

    def contrib(k):
        g = F.col("_g0") + k * F.col("_step")
        z = (g - F.col("_x")) / F.col("_h")
        return F.col("_c") * F.exp(-0.5 * z * z) * norm / (F.col("_h") * F.col("_n"))

    ex = j.select(by, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), contrib)).alias("point", "_d"))
    dens = ex.groupBy(by, "point").agg(F.sum("_d").alias("density"))
    return dens.join(stats.select(by, "_g0", "_step"), by).select(
        by,
        "point",
        F.round(F.col("_g0") + F.col("point") * F.col("_step"), DIGITS).alias("x"),
        F.round("density", DIGITS).alias("density"),
    )


def kde_binned(df: DataFrame, col: str, by: str, grid: int = 200, cut: float = 3.0, per_h: int = 32) -> DataFrame:
    """(group, point 0..grid-1, x, density): the density of ``kde`` for columns of many distinct values, in two passes over the rows.

    Values fall into bins of h / ``per_h``; a bin keeps its count and the first ``MOMENTS`` moments of the offsets from its middle, and the kernel is
    expanded around the middle (its derivatives are Hermite polynomials times the kernel).  An offset is at most u = 1 / (2 * per_h) bandwidths, so
    the relative truncation is below u^6 / 720 * max|He6| (2e-13 of the kernel's height at 32 bins a bandwidth).  Rows become one row per group and
    bin by a map-side combine; a bin meets the grid, a row never does.  Bins grow with range / h, not with the rows.

    NaN, infinite and null values and null groups take no part; groups with fewer than 2 values or zero spread emit nothing.
    """
    from starlens.session import materialise

    x = F.col(col).cast("double")
    d = df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & F.col(by).isNotNull()).select(by, x.alias("_x"))
    stats = d.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_x").alias("_sd"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    stats = stats.where("_n >= 2 and _sd > 0").withColumn("_h", F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2)))
    stats = stats.withColumn("_g0", F.col("_lo") - cut * F.col("_h"))
    stats = _group_side(stats.withColumn("_step", (F.col("_hi") - F.col("_lo") + 2 * cut * F.col("_h")) / F.lit(grid - 1)), "kde-groups")
    h, lo = F.col("_h"), F.col("_lo")
    placed = d.join(stats.select(by, "_lo", "_h"), by).withColumn("_bin", F.floor((F.col("_x") - lo) / h * per_h))
    placed = placed.select(by, "_bin", ((F.col("_x") - lo) / h - (F.col("_bin") + 0.5) / per_h).alias("_o"))  # offset in bandwidths
    moments = [F.sum(F.pow("_o", F.lit(k)) if k else F.lit(1.0)).alias(f"_m{k}") for k in range(MOMENTS + 1)]
    bins = materialise(placed.groupBy(by, "_bin").agg(*moments), "kde-bins").join(stats, by)
    middle = (F.col("_bin") + 0.5) / per_h  # in bandwidths above _lo

    def contrib(k):
        z = (F.col("_g0") + k * F.col("_step") - lo) / h - middle
        # phi(z - o) = phi(z) * sum of He_j(z) * o^j / j!
        he = [F.lit(1.0), z]
        for j in range(1, MOMENTS):
            he.append(z * he[j] - j * he[j - 1])
        total = F.col("_m0")
        for j in range(1, MOMENTS + 1):
            total = total + he[j] * F.col(f"_m{j}") / math.factorial(j)
        return F.exp(-0.5 * z * z) * total / (math.sqrt(2 * math.pi) * h * F.col("_n"))

    points = bins.select(by, *[c for c in bins.columns if c != by], F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    out = points.groupBy(by, "point").agg(F.sum(contrib(F.col("point"))).alias("density"), F.first("_g0").alias("_g0"), F.first("_step").alias("_step"))
    return out.select(by, "point", (F.col("_g0") + F.col("point") * F.col("_step")).alias("x"), "density")


def box_stats(df: DataFrame, col: str, by: str, whisker: float = 1.5) -> DataFrame:
    """Per group: exact quartiles, whiskers (furthest values within whisker·IQR of the box) and outlier count."""
    from starlens.session import materialise

    x = F.col(col).cast("double")
    d = df.filter(x.isNotNull() & F.col(by).isNotNull())
    # the only pass over the rows: (group, value, count), written once
    vals = materialise(d.groupBy(by, x.alias("_x")).agg(F.count(F.lit(1)).alias("_c")), "box-values")
    st = exact_quantiles(vals.select(by, F.col("_x").alias("value"), F.col("_c").alias("n")), by, (0.25, 0.5, 0.75))
    st = st.withColumnRenamed("q", "_q").select(
        by, "n", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3")
    ).withColumn("iqr", F.col("q3") - F.col("q1"))
    lo = F.col("q1") - whisker * F.col("iqr")
    hi = F.col("q3") + whisker * F.col("iqr")
    j = vals.join(_group_side(st, "box-groups"), by)
    inside = (F.col("_x") >= lo) & (F.col("_x") <= hi)
    agg = j.groupBy(by, "n", "q1", "median", "q3", "iqr").agg(
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("_c"))).cast("bigint").alias("n_outliers"),
    )
    return agg.select(
        by, "n", *[F.round(c, DIGITS).alias(c) for c in ("q1", "median", "q3", "iqr", "whisker_low", "whisker_high")], "n_outliers"
    )
