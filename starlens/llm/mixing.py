"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets: source ``i`` of weight ``w_i`` asks for ``w_i`` shares of all words but may not exceed ``max_epochs`` times its own
size; what a clamped source leaves is shared again by weight until no source is above its cap.  Only two
scalars go to the driver per round.

Sampling: a source with target / size = r has every document taken floor(r) times.  The fraction is filled
by a seeded order of its documents: a histogram over hash buckets finds the bucket where the running size
passes the fraction, and only that bucket's rows are ordered.  The last document is taken when that brings the
source closer to its target, so a source misses it by at most half a document.

Defined cases: null text counts as empty (size 0, never taken twice or more than its share: it has no words); a null source
is a source of its own, last in order; rows of equal id and text are separate rows that are ordered by id only, so ties at the
boundary are taken together; an empty table gives an empty result; other columns pass through ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from starlens.llm.base import fresh_name, materialise, partitions
from starlens.llm.registry import register, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20
BUCKETS = 4096  # hash buckets a source is cut into to find where its fraction ends


def n_words(text: str | Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts as empty."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("string")
    return F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_ranks(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, source_size) with the source's 0-based place by code point, null last.

    Sorted by range partitions; only each partition's row count is summed over the partitions.
    """
    n = partitions(sizes.sparkSession)
    parts = sizes.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    kept = materialise(parts, "mix-sources")
    before = kept.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    place = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return kept.withColumn("place", place).join(before.select("part", "before"), "part").select(
        "source", "source_size", (F.col("place") + F.col("before")).alias("rank")
    )


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).  One aggregate per round of clamping."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    s = materialise(
        source_ranks(sizes).select("source", "source_size", weight.cast("long").alias("w"), (F.col("source_size") * max_epochs).alias("cap")), "mix-weights"
    )
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    left, share, clamped = total, 0, F.lit(False)
    while True:
        free = s.where(~clamped).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()["w"]
        gone = s.where(clamped).agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("c")).first()["c"]
        same = (left, share) == (total - gone, free)
        left, share = total - gone, free
        if same or not share:
            break
        # above its cap when w * left / share > cap, in whole numbers; what is clamped stays clamped
        asked = (F.col("w").cast("decimal(38,0)") * F.lit(left).cast("decimal(20,0)")) >= F.col("cap").cast("decimal(38,0)") * F.lit(share).cast("decimal(18,0)")
        clamped = asked
    free_target = F.col("w") * F.lit(left) / F.lit(max(share, 1))
    return s.select("source", "source_size", F.when(clamped, F.col("cap").cast("double")).otherwise(free_target.cast("double")).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per document: key, source, size, source_size, target, repeats (times it is taken), taken (words)."""
    # place: 31 bits of a seeded digest of the key
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 7), 16, 10).cast("long")
    d = materialise(docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), n_words(text).alias("size"), u.alias("u")), "mix-docs")
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = water_fill(sizes, weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    t = t.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    cut = 2**28 // BUCKETS
    hist = d.groupBy("source", F.floor(F.col("u") / cut).cast("long").alias("b")).agg(F.sum("size").alias("in_b"))
    run = F.sum("in_b").over(W.partitionBy("source").orderBy("b"))  # at most BUCKETS rows a source
    edge = hist.withColumn("upto", run).join(t.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    # the bucket in which the running size passes what is needed
    edge = edge.where((F.col("upto") > F.col("need")) & (F.col("upto") - F.col("in_b") <= F.col("need")) & (F.col("in_b") > 0)).select(
        F.col("s").alias("es"), F.col("b").alias("eb"), (F.col("upto") - F.col("in_b")).alias("before")
    )
    t = materialise(
        t.join(edge, F.col("source").eqNullSafe(F.col("es")), "left").select(F.col("source").alias("ts"), "source_size", "target", "whole", "need", "eb", "before"), "mix-targets"
    )
    j = d.join(t, F.col("source").eqNullSafe(F.col("ts"))).withColumn("b", F.floor(F.col("u") / cut).cast("long"))
    inside = j.where(F.col("b") == F.col("eb"))
    outside = j.where(~F.col("b").eqNullSafe(F.col("eb")))
    upto = F.col("before") + F.sum("size").over(W.partitionBy("source", "b").orderBy("u", "id"))
    # taken while the middle of the document lies below what is needed
    inside = inside.withColumn("extra", (upto - F.col("size") / 2 <= F.col("need")).cast("long"))
    outside = outside.withColumn("extra", (F.col("eb").isNull() & (F.col("need") > 0) | (F.col("b") < F.col("eb"))).cast("long"))
    out = inside.unionByName(outside).withColumn("repeats", F.col("whole") + F.coalesce(F.col("extra"), F.lit(0)))
    return out.select("id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each repeated as often as the mix takes it (not at all for 0)."""
    times, one, its_source, its_size = (fresh_name(docs, n) for n in ("mix_repeats", "mix_id", "mix_source", "mix_size"))
    # rows of one id, source and size are taken alike
    r = mix(docs, key, text, source, **options).groupBy(F.col("id").alias(one), F.col("source").alias(its_source), F.col("size").alias(its_size))
    r = r.agg(F.max("repeats").cast("int").alias(times))
    same = F.col(key).eqNullSafe(F.col(one)) & F.col(source).cast("string").eqNullSafe(F.col(its_source)) & (n_words(text) == F.col(its_size))
    j = docs.join(r.where(F.col(times) > 0), same)
    return j.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST(('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 7)) AS BIGINT) AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
tot AS (SELECT CAST(sum(source_size) AS BIGINT) AS total FROM s),
-- by rising cap per weight: a source is clamped when the share left for it reaches its cap
o AS (
  SELECT s.*, total - coalesce(CAST(sum(3 * source_size) OVER p AS BIGINT), 0) AS left_here,
    CAST(sum(w) OVER q AS BIGINT) AS w_here
  FROM s, tot
  WINDOW p AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    q AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c AS (SELECT *, w * left_here >= 3 * source_size * w_here AS clamped FROM o),
z AS (SELECT total - coalesce((SELECT CAST(sum(3 * source_size) AS BIGINT) FROM c WHERE clamped), 0) AS rest, (SELECT CAST(sum(w) AS BIGINT) FROM c WHERE NOT clamped) AS ws FROM tot),
t AS (
  SELECT source, source_size, CASE WHEN clamped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w * rest AS DOUBLE) / ws END AS target FROM c, z),
n AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, n.source_size, n.target, n.whole, n.target - n.whole * n.source_size AS need,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY u, doc_id) AS BIGINT) AS upto
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN need > 0 AND upto - size / 2.0 <= need THEN 1 ELSE 0 END) AS taken FROM r
"""


@register("op2_mix_sources", ORACLE)
def op2_mix_sources(spark, sf_dir):
    m = mix(table(spark, sf_dir, "documents"))
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
