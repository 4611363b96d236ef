"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

quality rules -> exact dedup -> SimHash near-dedup -> mix to target weights -> best-fit packing.  Every stage but the last returns
the columns of ``documents``; a stage's decisions take effect: what it rejects is gone, what the mix takes twice is there twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starlens.llm.base import materialise
from starlens.llm.block_naming import drop_copies
from starlens.llm.mixing import mix_documents
from starlens.llm.packing import pack_documents
from starlens.llm.quality_rules import apply_rules
from starlens.llm.simhash_balls import keep_representatives


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return apply_rules(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z without regard to case), the document with the largest doc_id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of SimHash links, the document with the smallest doc_id."""
    return keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in the sequences."""
    return pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

# SQL has neither the fingerprints nor the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
