"""Deterministic samples, splits, caps and heads.

The order of a sample is ``md5(seed | key)`` (ties by key): it does not depend on partitioning, file order or executor
count, and DuckDB computes the same order, so every result here has an exact SQL oracle.

Samples, splits and caps are ordered by the hash (``hashed_cuts``): rows are counted per (stratum, hash prefix) with a map-side combine, running
counts name the bucket in which a stratum's cut falls, and that bucket alone is refined by its next digits until it is
small; only its rows are ordered.  Nothing is sorted for the rest.

Heads by a key of the rows have no such prefix (``cut_rows``): the order columns alone are range-partitioned by (strata, order) and
written once, sorted; the rows of each (stratum, partition) are counted; running counts name the partition in which a stratum's
cut falls, and the row number inside that one partition names the cut row.  Every input row is then labelled by comparing its
own order columns with its stratum's cut row: no window over a stratum, no merge of many partial top-ns in one task, no
union.  The result equals ``row_number() over (partition by strata order by ...) <= t``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlens.session import materialise

DEFAULT_SEED = 42


def order_hash(keys: Sequence[str], seed: int = DEFAULT_SEED) -> Column:
    """md5 hex of ``seed|key…`` — the sampling order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def cut_rows(df: DataFrame, strata: dict[str, Column], order: dict[str, Column], target: Callable[[Column], Column]) -> DataFrame:
    """Per stratum (strata columns, order columns) the ``target(n)``-th row in order, nulls first; none where the target is 0."""
    s, o = list(strata), list(order)
    by = [F.col(c).asc_nulls_first() for c in (*s, *o)]
    narrow = df.select(*[c.alias(n) for n, c in {**strata, **order}.items()])
    placed = narrow.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_p", F.spark_partition_id())
    placed = materialise(placed, "sample-order")
    counts = placed.groupBy(*s, "_p").agg(F.count(F.lit(1)).alias("_c"))
    # one row per (stratum, partition); without strata that is one row per partition
    whole = Window.partitionBy(*s)
    counts = counts.withColumn("_upto", F.sum("_c").over(whole.orderBy("_p"))).withColumn("_n", F.sum("_c").over(whole))
    counts = counts.withColumn("_t", F.least(target(F.col("_n")).cast("bigint"), F.col("_n")))
    hit = counts.where((F.col("_upto") >= F.col("_t")) & (F.col("_upto") - F.col("_c") < F.col("_t")))
    hit = hit.select(*[F.col(c).alias(f"_h{c}") for c in s], F.col("_p").alias("_hp"), (F.col("_t") - F.col("_upto") + F.col("_c")).alias("_k"))
    same = F.col("_p") == F.col("_hp")
    for c in s:
        same = same & F.col(c).eqNullSafe(F.col(f"_h{c}"))
    inside = placed.join(hit, same)
    nth = F.row_number().over(Window.partitionBy(*s, "_p").orderBy(*[F.col(c).asc_nulls_first() for c in o]))
    return inside.withColumn("_i", nth).where(F.col("_i") == F.col("_k")).select(*s, *o)


PREFIX = 4  # hex digits by which rows are counted, and a bucket is refined, at a time
SMALL_BUCKET = 100_000  # rows of a bucket that are ordered by a window


def hashed_cuts(df: DataFrame, strata: dict[str, Column], order: dict[str, Column], target: Callable[[Column], Column], small: int = SMALL_BUCKET) -> DataFrame:
    """``cut_rows`` where the first order column is a hash in hex digits: by counts of its prefixes, without a sort of all rows."""
    s, o = list(strata), list(order)
    narrow = df.select(*[c.alias(n) for n, c in {**strata, **order}.items()])
    same = lambda d, names: [F.col(c).eqNullSafe(F.col(f"_h{c}")) for c in names]
    inside, left, digits = narrow, None, 0
    while True:
        digits += PREFIX
        counts = inside.groupBy(*s, F.substring(o[0], 1, digits).alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
        whole = Window.partitionBy(*s)  # at most 16 ** PREFIX rows a stratum
        counts = counts.withColumn("_upto", F.sum("_c").over(whole.orderBy("_b")))
        if left is None:
            n = F.sum("_c").over(whole)
            counts = counts.withColumn("_k", F.least(target(n).cast("bigint"), n))
        elif not s:  # one cut row, or none
            row = left.first()
            counts = counts.withColumn("_k", F.lit(row["_k"] if row else 0))
        else:
            named = left.select(*[F.col(c).alias(f"_h{c}") for c in s], F.col("_k"))
            counts = counts.join(named, _all(same(counts, s)))
        hit = counts.where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_c") < F.col("_k")))
        left = materialise(hit.select(*s, "_b", "_c", (F.col("_k") - F.col("_upto") + F.col("_c")).alias("_k")), "sample-buckets")
        bucket = left.select(*[F.col(c).alias(f"_h{c}") for c in s], F.col("_b").alias("_hb"), F.col("_k").alias("_hk"))
        inside = narrow.withColumn("_b", F.substring(o[0], 1, digits)).join(bucket, _all([*same(narrow, s), F.col("_b") == F.col("_hb")]))
        if digits >= 32 or left.where(F.col("_c") > small).isEmpty():
            break
        inside = inside.select(*s, *o)
    nth = F.row_number().over(Window.partitionBy(*s, "_b").orderBy(*[F.col(c).asc_nulls_first() for c in o]))
    return inside.withColumn("_i", nth).where(F.col("_i") == F.col("_hk")).select(*s, *o)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def rank_select(
    df: DataFrame,
    strata: Sequence[str],
    order: dict[str, Column],
    target: Callable[[Column], Column],
    out: str = "_sel",
    hashed: bool = False,
) -> DataFrame:
    """Add boolean ``out``: the row is among the first ``target(n)`` rows of its stratum in ``order`` (a unique order); ``hashed``: its
    first column is a hash in hex digits."""
    names = {f"_s{i}": F.col(c) for i, c in enumerate(strata)}
    cuts = materialise((hashed_cuts if hashed else cut_rows)(df, names, order, target), "sample-cuts")
    mine = F.struct(*order.values())
    if not names:  # one cut row, or none when nothing is selected
        rows = cuts.limit(1).collect()
        if not rows:
            return df.withColumn(out, F.lit(False))
        kinds = dict(cuts.dtypes)
        return df.withColumn(out, mine <= F.struct(*[F.lit(rows[0][c]).cast(kinds[c]) for c in order]))
    same = F.lit(True)
    for n, c in names.items():
        same = same & c.eqNullSafe(F.col(n))
    labelled = df.join(cuts.withColumn("_cut", F.struct(*order)).select(*names, "_cut"), same, "left")
    return labelled.withColumn(out, F.coalesce(mine <= F.col("_cut"), F.lit(False))).drop(*names, "_cut")


def _hashed(keys: Sequence[str], seed: int) -> dict[str, Column]:
    return {"_o0": order_hash(keys, seed), **{f"_o{i + 1}": F.col(k) for i, k in enumerate(keys)}}


def sample_n(df: DataFrame, n: int, keys: Sequence[str], seed: int = DEFAULT_SEED) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement, seeded, in no particular order; ``keys`` are unique."""
    return rank_select(df, [], _hashed(keys, seed), lambda _: F.lit(n), hashed=True).filter("_sel").drop("_sel")


def stratified_split(df: DataFrame, strata: Sequence[str], keys: Sequence[str], frac: float = 0.8, seed: int = DEFAULT_SEED) -> DataFrame:
    """Per stratum, the first ⌊frac·n⌋ rows by hash are ``train``, the rest ``test`` (adds ``split``)."""
    sel = rank_select(df, strata, _hashed(keys, seed), lambda n: F.floor(n * F.lit(frac)), hashed=True)
    return sel.withColumn("split", F.when(F.col("_sel"), "train").otherwise("test")).drop("_sel")


def train_test(df: DataFrame, keys: Sequence[str], test: float = 0.2, seed: int = DEFAULT_SEED) -> DataFrame:
    """One seeded split; the test side has ⌈test·n⌉ rows (adds ``split``)."""
    sel = rank_select(df, [], _hashed(keys, seed), lambda n: n - F.ceil(n * F.lit(test)), hashed=True)
    return sel.withColumn("split", F.when(F.col("_sel"), "train").otherwise("test")).drop("_sel")


def cap_per_group(df: DataFrame, group: str, cap: int, keys: Sequence[str], seed: int = DEFAULT_SEED) -> DataFrame:
    """At most ``cap`` rows per group (0 = no cap), chosen in hash order."""
    if cap <= 0:
        return df
    return rank_select(df, [group], _hashed(keys, seed), lambda _: F.lit(cap), hashed=True).filter("_sel").drop("_sel")


def shuffled(df: DataFrame, keys: Sequence[str], seed: int = DEFAULT_SEED) -> DataFrame:
    """Seeded shuffle: rows carry ``shuffle_key`` and are range-sorted by it (no single-task step)."""
    return df.withColumn("shuffle_key", order_hash(keys, seed)).orderBy("shuffle_key", *keys)


def head_n(df: DataFrame, n: int, key: str | Sequence[str]) -> DataFrame:
    """First n rows by ``key`` ascending, nulls first (Spark has no file order).

    ``key`` is a column or, where it has ties, several columns that are unique together: rows that tie at the cut are taken together.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = {f"_o{i}": F.col(k) for i, k in enumerate(keys)}
    return rank_select(df, [], order, lambda _: F.lit(n)).filter("_sel").drop("_sel")
