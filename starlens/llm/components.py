"""Connected components of links between long ids, as Spark jobs (alternating large and small stars).

Only ids that have a link take part.  A large star hangs every larger neighbour of a node on the node's smallest
neighbour, a small star does so with the smaller ones; both keep components whole, and the rounds end when the links are one star
for each component.  A node's smallest neighbour is an aggregate with a map-side combine, written before it
meets the links, so that AQE can split the links of a hot node.  Each round is written to the shared folder, which also cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.base import materialise


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Links (u, v), u > v, to the links after one large or small star."""
    if larger:  # seen from every node, its larger neighbours
        sides = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        hung = links.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u")
    else:  # seen from the larger node, its smaller neighbours
        least = materialise(links.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        hung = links.join(least, "u")
        hung = hung.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
    return hung.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (id, root) for every linked id; root is the smallest id of the component."""
    now = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialise(now, "cc-links")
    before = None
    while True:
        # order-free digest of the link set: equal digests and counts mean that the round changed nothing
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u", F.lit(1)).cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        now = materialise(_star(materialise(_star(now, True), "cc-links"), False), "cc-links")
    members = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return members.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
