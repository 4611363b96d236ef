"""Vocabulary, term counts and TF-IDF in long form (doc, term, value).

Plan: a document's terms are counted within its row (sort, then runs), so nothing of the size of the text is shuffled; it is
written only by ``counted``, for the counts that two steps read.  Corpus statistics are one aggregate per term with a map-side combine; a bounded vocabulary turns documents into
weights in place, an unbounded one is joined by term.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlens.functions.text import tokens
from starlens.session import materialise

# Spark's default English stop words (StopWordsRemover), the entries a token
# of two or more word characters can equal (no apostrophes, no single letters).
STOP_WORDS_EN = (
    "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did",
    "doing", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for",
    "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below",
    "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most",
    "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "can",
    "will", "just", "don", "should", "now", "cannot", "could", "ought", "would",
)


def words(text: str, stop: Sequence[str] = STOP_WORDS_EN) -> Column:
    """Tokens of a text without stop words, in order."""
    toks = tokens(F.col(text))
    return F.filter(toks, lambda t: ~t.isin(*stop)) if stop else toks


def _counted(ws: Column) -> Column:
    """array<(term, tf)> of an array of words: sorted, then cut where a run of equal words ends.  Linear after the sort."""

    def runs(s):
        last = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == F.size(s) - 1) | (F.get(s, i) != F.get(s, i + 1)))
        return F.transform(last, lambda e: F.struct(F.get(s, e).alias("term"), (e + 1).cast("long").alias("upto")))

    ends = F.when(F.size(ws) > 0, F.element_at(F.transform(F.array(F.sort_array(ws)), runs), 1))
    tf = lambda r: F.transform(
        r, lambda x, i: F.struct(x["term"].alias("term"), (x["upto"] - F.when(i > 0, F.get(r, i - 1)["upto"]).otherwise(F.lit(0))).alias("tf"))
    )
    return F.when(ends.isNotNull(), F.element_at(F.transform(F.array(ends), tf), 1)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))


COUNTS = "_term_counts"


def counted(df: DataFrame, text: str, keep: Sequence[str], stop: Sequence[str] = STOP_WORDS_EN) -> DataFrame:
    """(keep…, term counts) of each document, written once: ``corpus_terms`` and ``doc_terms`` of this frame don't clean and cut the text again."""
    return materialise(_terms_of(df, text, keep, stop).withColumnRenamed("_t", COUNTS), "term-counts")


def _terms_of(df: DataFrame, text: str, keep: Sequence[str], stop: Sequence[str]) -> DataFrame:
    """(keep…, ``_t`` array<(term, tf)>): the counts that the frame brings along (``counted``), else those of the text."""
    if COUNTS in df.columns:
        return df.select(*keep, F.col(COUNTS).alias("_t"))
    return df.select(*keep, words(text, stop).alias("_w")).select(*keep, _counted(F.col("_w")).alias("_t"))


def doc_terms(df: DataFrame, text: str, keep: Sequence[str], stop: Sequence[str] = STOP_WORDS_EN) -> DataFrame:
    """(keep…, term, tf): term counts of each document, made within the row: no exchange."""
    return _terms_of(df, text, keep, stop).select(*keep, F.inline("_t"))


def corpus_terms(df: DataFrame, text: str, stop: Sequence[str] = STOP_WORDS_EN) -> tuple[DataFrame, int]:
    """((term, term_count, doc_freq) of the whole corpus, number of documents) in one pass over the text.

    Only per-term sums are shuffled, after a map-side combine; every document also adds one to a marker without a term, which
    is the document count.  The result, one row per term, is written once.
    """
    marker = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).cast("bigint").alias("tf")))
    d = _terms_of(df, text, [], stop).select(F.inline(F.concat(F.col("_t"), marker)))
    stats = materialise(d.groupBy("term").agg(F.sum("tf").alias("term_count"), F.count(F.lit(1)).alias("doc_freq")), "corpus-terms")
    n = stats.where(F.col("term").isNull()).select("doc_freq").first()
    return stats.where(F.col("term").isNotNull()), int(n[0]) if n else 0


def term_stats(
    stats: DataFrame,
    n_docs: int,
    min_df: float = 10,
    max_df: float = 0.95,
    max_features: int | None = 1000,
) -> DataFrame:
    """(term, term_count, doc_freq, term_rank) after the document-frequency bounds and the top-N cut.

    ``min_df``/``max_df``: an int is a document count, a float a share of ``n_docs``.  Ties in the top-N
    cut are broken by term, ascending.
    """
    lo = min_df if isinstance(min_df, int) else min_df * n_docs
    hi = max_df if isinstance(max_df, int) else max_df * n_docs
    st = stats.filter((F.col("doc_freq") >= F.lit(lo)) & (F.col("doc_freq") <= F.lit(hi)))
    if not max_features:
        return st
    st = st.orderBy(F.desc("term_count"), F.asc("term")).limit(max_features)
    w = Window.orderBy(F.desc("term_count"), F.asc("term"))
    # the window runs over the kept vocabulary only (≤ max_features rows)
    return st.withColumn("term_rank", F.row_number().over(w) - 1)


def tfidf(df: DataFrame, text: str, keep: Sequence[str], vocab: DataFrame, n_docs: int, stop: Sequence[str] = STOP_WORDS_EN) -> DataFrame:
    """(keep…, term, weight): tf · (ln((1+n)/(1+df)) + 1), L2-normalised per document (smooth idf).

    ``vocab`` is a bounded vocabulary (``term_stats`` with ``max_features``): it goes into a fitted count vectoriser, as every
    TF-IDF model holds its vocabulary, and each document is turned into its weights within its row: no exchange.
    """
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    rows = vocab.select("term", "doc_freq").orderBy("term").collect()
    if not rows:
        return df.select(*keep, F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("weight")).limit(0)
    terms = [r[0] for r in rows]
    idf = [math.log((1.0 + n_docs) / (1.0 + r[1])) + 1.0 for r in rows]
    d = df.select(*keep, words(text, stop).alias("_w"))
    d = CountVectorizerModel.from_vocabulary(terms, inputCol="_w", outputCol="_tf").transform(d)
    d = ElementwiseProduct(inputCol="_tf", outputCol="_x", scalingVec=Vectors.dense(idf)).transform(d)
    d = Normalizer(inputCol="_x", outputCol="_n", p=2.0).transform(d)
    pairs = F.filter(F.transform(vector_to_array("_n"), lambda v, i: F.struct(i.alias("i"), v.alias("weight"))), lambda p: p["weight"] > 0)
    names = F.array(*map(F.lit, terms))
    return d.select(*keep, F.inline(pairs)).select(*keep, F.get(names, F.col("i")).alias("term"), "weight")


def count_matrix(dt: DataFrame, vocab: DataFrame) -> DataFrame:
    """(keep…, term, tf) restricted to the vocabulary; the written vocabulary's size decides between a broadcast and a shuffle join."""
    return dt.join(vocab.select("term"), "term", "left_semi")


def top_terms(weights: DataFrame, group: str, k: int = 10, value: str = "weight") -> DataFrame:
    """Per group, the k terms with the highest value (ties by term)."""
    w = Window.partitionBy(group).orderBy(F.desc(value), F.asc("term"))
    return weights.withColumn("term_rank", F.row_number().over(w)).filter(F.col("term_rank") <= k)


def centroid_weights(weights: DataFrame, sizes: DataFrame, group: str) -> DataFrame:
    """(group, term, weight): mean TF-IDF weight per group (the centroid of each cluster).

    ``weights`` carry their group; ``sizes`` (group, n) counts all members, those without a term too.
    """
    sums = weights.groupBy(group, "term").agg(F.sum("weight").alias("_s"))
    return sums.join(sizes.withColumnRenamed("n", "_n"), group).select(group, "term", (F.col("_s") / F.col("_n")).alias("weight"))


def cluster_keywords(counts: DataFrame, group: str, k: int = 10) -> DataFrame:
    """Per cluster: the k terms with the largest summed count; ``counts`` carry their cluster."""
    return top_terms(counts.groupBy(group, "term").agg(F.sum("tf").alias("term_count")), group, k, "term_count")
