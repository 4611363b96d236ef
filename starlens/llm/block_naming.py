"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of fixed size.  Equal blocks get one integer name, given out in sorted order; then
adjacent pairs of names are named in the same way, level by level, until each document has one integer.  Two documents have
the same number of blocks and the same name exactly when their texts are equal: names come from comparing
contents, so no hash collision can merge two texts.

Contents are shuffled once, with a map-side combine: ``groupBy(fingerprint, block)`` keeps one row per
distinct block, so a text that a third of the documents share is one row per map task.  Documents then fetch names by the
16-byte fingerprint; blocks whose fingerprint stands for several contents (none, in practice) are named and fetched by
content.  Hot names are split by AQE's skew join, on the document side.

Defined cases: null counts as the empty text; all empty texts are one group; texts of any length are read whole; rows
of one id are separate rows, and of equal rows one stays; a null id is smaller than any other; an empty table gives an
empty result; other columns pass through ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.llm.base import fresh_name, materialise, numbered
from starlens.llm.registry import register, table

BLOCK = 4096  # code points in a block


def normalised(text: str) -> Column:
    """Lower-cases A-Z only; null counts as empty.  Texts without other letters than ASCII take the faster ``lower``."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    by_letter = F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(by_letter)


def fingerprint(block: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a block: a short key for it, never its name."""
    return F.xxhash64(block), F.xxhash64(F.lit("b"), block)


def _named(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``name``: partition number and place among the partition's sorted rows.

    ``distinct`` comes from a hash exchange, so its rows are spread evenly whatever they hold.
    """
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def name_blocks(blocks: DataFrame, hashes=fingerprint) -> DataFrame:
    """(row, n_blocks, i, block) -> (row, n_blocks, i, name)."""
    h1, h2 = hashes(F.col("block"))
    b = blocks.select("row", "n_blocks", "i", h1.alias("h1"), h2.alias("h2"), "block")
    distinct = b.groupBy("h1", "h2", "block").agg(F.count(F.lit(1)).alias("copies"))
    names = materialise(_named(distinct, ["h1", "h2", "block"]).select("h1", "h2", "name"), "block-names")
    clash = materialise(names.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"), "block-clashes")
    here = b.drop("block")
    if clash.isEmpty():
        return here.join(names, ["h1", "h2"]).select("row", "n_blocks", "i", "name")
    sure = here.join(names.join(clash, ["h1", "h2"], "left_anti"), ["h1", "h2"]).select("row", "n_blocks", "i", "name")
    rest = b.join(clash, ["h1", "h2"], "left_semi")
    # below zero, so that these names and the others differ
    by_content = rest.select("h1", "h2", "block").distinct()
    by_content = materialise(_named(by_content, ["h1", "h2", "block"]).withColumn("name", -F.col("name") - 2), "block-names")
    unsure = rest.join(by_content, ["h1", "h2", "block"]).select("row", "n_blocks", "i", "name")
    return sure.unionByName(unsure)


def name_pairs(level: DataFrame) -> DataFrame:
    """(row, n_blocks, i, name) -> the same with i halved: the name of two adjacent names; an odd last one is paired with -1."""
    at = lambda odd: F.coalesce(F.max(F.when(F.col("i") % 2 == odd, F.col("name"))), F.lit(-1))
    pairs = level.groupBy("row", "n_blocks", F.shiftright("i", 1).alias("j")).agg(at(0).alias("a"), at(1).alias("b"))
    pairs = materialise(pairs, "name-pairs")
    names = materialise(_named(pairs.select("a", "b").distinct(), ["a", "b"]), "pair-names")
    return pairs.join(names, ["a", "b"]).select("row", "n_blocks", F.col("j").alias("i"), "name")


def identify(docs: DataFrame, block: int = BLOCK, hashes=fingerprint) -> DataFrame:
    """(row, t) -> (row, n_blocks, name) for every row whose normalised text ``t`` is not empty."""
    cut = docs.select("row", F.regexp_extract_all("t", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)).alias("parts"))
    blocks = cut.select("row", F.size("parts").alias("n_blocks"), F.posexplode("parts").alias("i", "block"))
    level = materialise(name_blocks(blocks, hashes), "block-level")
    most = level.agg(F.max("n_blocks")).first()[0] or 0
    done, width = [], 1
    while True:
        # documents whose blocks have met in one name are done; the others go up a level
        done.append(level.where(F.col("n_blocks") <= width).select("row", "n_blocks", "name"))
        if width >= most:
            break
        level = materialise(name_pairs(level.where(F.col("n_blocks") > width)), "block-level")
        width *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, hashes=fingerprint) -> DataFrame:
    """One row per row of ``docs``: row, id, keep_id, group_size, kept, text_sha256."""
    d = numbered(docs, key, {"id": F.col(key).cast("long"), "t": normalised(text)})
    names = identify(d.select("row", "t"), block, hashes)
    rows = d.select("row", "id", F.sha2(F.encode("t", "UTF-8"), 256).alias("text_sha256"))
    rows = rows.join(names, "row", "left").select(
        "row", "id", "text_sha256", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce("name", F.lit(0)).alias("name")
    )
    rows = materialise(rows, "exact-names")
    groups = rows.groupBy("n_blocks", "name").agg(F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    groups = materialise(groups, "exact-groups")  # a plain table, so that AQE can split a hot name in the join
    return rows.join(groups, ["n_blocks", "name"]).select(
        "row", "id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; of equal rows of one id, one."""
    stay, sha, mine = (fresh_name(docs, x) for x in ("stay_id", "stay_sha", "own_sha"))
    groups = exact_groups(docs, key, text, **options)
    kept = groups.where("kept").select(F.col("id").alias(stay), F.col("text_sha256").alias(sha))
    tagged = docs.withColumn(mine, F.sha2(F.encode(normalised(text), "UTF-8"), 256))
    out = tagged.join(kept, F.col(f"`{key}`").eqNullSafe(F.col(stay)) & (F.col(mine) == F.col(sha)), "left_semi")
    if not groups.groupBy("id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        out = out.dropDuplicates([key, mine])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


@register("op6_exact_dedup", ORACLE)
def op6_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")
