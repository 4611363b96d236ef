"""Driver tables and the fixture views that give them the shape of review data.

V1 ``reviews``       lineitem ⋈ orders ⋈ part  → numeric review analysis (products, users, months)
V2 ``review_texts``  documents                  → text, cleaning, topics, product risk
V3 ``lexicon``       500 most frequent tokens of documents with a deterministic valence in -4..4

The joins in V1 are plain equi-joins; Catalyst prunes every unused column at the Parquet scan and AQE
picks broadcast vs sort-merge from runtime sizes (part/orders are never force-broadcast: both grow
with the scale factor).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.functions.text import TOKEN

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

LEXICON_SIZE = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _s(c) -> F.Column:
    return F.col(c).cast("string")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: one scored review per lineitem row."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    qty = F.col("l_quantity").cast("int")
    pk = F.col("l_partkey").cast("int")
    review_id = F.md5(
        F.concat_ws(
            "|",
            _s("l_orderkey"), _s("l_linenumber"), _s("l_partkey"), _s("l_suppkey"),
            qty.cast("string"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        )
    )
    predict = F.when((F.col("l_linenumber") == 7) & (F.col("l_suppkey") % 5 == 0), F.lit(None)).otherwise(
        1 + (qty + pk + F.when(F.col("l_discount") >= 0.07, 2).otherwise(0)) % 5
    )
    return j.select(
        review_id.alias("review_id"),
        F.col("p_type").alias("category"),
        F.concat(F.lit("P"), _s("l_partkey")).alias("asin"),
        F.concat(F.lit("B"), F.col("p_brand")).alias("parent_asin"),
        F.concat(F.lit("U"), _s("o_custkey")).alias("user_id"),
        F.col("p_name").alias("title"),
        (1 + (qty + pk) % 5).alias("rating"),
        predict.cast("int").alias("predict_stars"),
        (F.col("l_returnflag") != "R").alias("verified_purchase"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("helpful_vote"),
        F.col("l_shipdate").alias("review_time"),
    )


def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: one review per document, with injected nulls / blanks and a fixed stand-in topic."""
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    title = (
        F.when(doc % 11 == 0, F.lit(None))
        .when(doc % 11 == 1, F.lit("  "))
        .otherwise(F.concat(F.col("lang"), F.lit(" review "), _s("doc_id")))
    )
    return d.select(
        doc.alias("review_id"),
        F.col("source").alias("asin"),
        F.concat(F.lit("U"), (doc % 97).cast("string")).alias("user_id"),
        F.col("lang").alias("category"),
        title.alias("title"),
        F.when(doc % 17 == 0, F.lit(None)).otherwise(F.col("text")).alias("text"),
        (1 + doc % 5).cast("int").alias("rating"),
        F.when(doc % 29 == 0, F.lit(None)).otherwise((1 + (doc + doc % 7) % 5).cast("int")).alias("predict_stars"),
        (doc % 4 != 0).alias("verified_purchase"),
        (doc % 13).alias("helpful_vote"),
        (F.lit(1577836800000) + (doc % 1900) * 86400000 + (doc % 24) * 3600000).alias("timestamp"),
        (((doc % 35) - (doc % 7)) / 7).cast("int").alias("topic"),
        F.when(doc % 3 == 0, F.lit(None))
        .otherwise(F.array_repeat(F.lit("img"), (doc % 3).cast("int")))
        .alias("images"),
    )


def lexicon(spark: SparkSession, sf_dir: str, size: int = LEXICON_SIZE) -> DataFrame:
    """V3: (token, valence).  Bounded by ``size`` rows, so it is safe to broadcast."""
    d = table(spark, sf_dir, "documents").select("text")
    terms = (
        d.select(F.explode(F.regexp_extract_all(F.lower(F.col("text")), F.lit(TOKEN), 0)).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("term"))
        .limit(size)
    )
    valence = (F.conv(F.substring(F.md5(F.col("term")), 1, 4), 16, 10).cast("bigint") % 9).cast("int") - 4
    return terms.select(F.col("term").alias("token"), valence.alias("valence"))
