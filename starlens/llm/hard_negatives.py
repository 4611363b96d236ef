"""Hard-negative mining by a secondary-sort shuffle.

Every anchor is scored against every row, in blocks: a group holds one block of rows and one block of anchors, and their scores are a matrix
product that never leaves the task.  A block sends on only what can reach the result: of an anchor's same-label rows the block's first
``positives`` (first pass), and of the other rows the block's first ``negatives`` in each window of the anchor's positives (second
pass).  What is sent is packed into one key (anchor, falling score, id) whose bytes sort in that order, and
``repartitionAndSortWithinPartitions`` deals the keys by anchor.  An iterator then reads an anchor's rows once, best score first: a positive opens its
window, a negative goes to the windows that it lies in, and a window that is full is closed.  It holds the open windows of one
anchor and nothing else.

A positive of score p > 0 has its window below it, so it is always open before its negatives come; at p = 0 the window is the score 0 itself, and
negatives of score 0 with smaller ids come first, so the first few of those are kept; at p < 0 the window is empty.

Rows are dealt to blocks by their place in the written table and anchors by a hash of their id, which is theirs alone, so no label, vector, id
or anchor is hot.

Defined cases: rows with a null id, label or vector, or a null or non-finite component (or one of 2**1015 or more) take no part; a row meets anchors of its own
dimension only; scores are exact whole numbers at any size, and pairs whose score needs more than 64 bits take no part; ties go
by id; rows that repeat an id are rows of their own but never partners of that id, and of an anchor's repeated rows the first by label and vector is
the anchor; an empty table gives an empty result; columns other than those named are not read, so their names can't clash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlens.llm.base import materialise, partitions
from starlens.llm.registry import register, table

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = (50, 100), (95, 100)  # a negative's score lies within these shares of the positive's
ROW_BLOCK = 2048  # rows of a group
ANCHOR_BLOCK = 2048  # anchors of a group
SLICE = 64  # anchors scored at a time
TOP = 1 << 63
KEY = struct.Struct(">QQQ")  # anchor, falling score, id: unsigned, so that bytes sort as the numbers do
EXACT = 1 << 53  # whole numbers below this are exact in floating point
OUTPUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def pack(anchor: int, score: int, row: int) -> bytes:
    return KEY.pack(anchor + TOP, TOP - 1 - score, row + TOP)


def unpack(key: bytes) -> tuple[int, int, int]:
    a, s, r = KEY.unpack(key)
    return a - TOP, TOP - 1 - s, r - TOP


def in_window(positive: int, score: int, low: tuple[int, int] = LOW, high: tuple[int, int] = HIGH) -> bool:
    return low[0] * positive <= low[1] * score and high[1] * score <= high[0] * positive


def scores(anchors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Inner products of whole numbers, exact; with them which ones fit 64 bits, or None where all do."""
    reach = int(np.abs(anchors).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(anchors.shape[1], 1)
    if reach < EXACT:
        return (anchors @ rows.T).astype(np.int64), None
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    exact = whole(anchors) @ whole(rows).T
    fits = np.array([[-TOP <= x < TOP for x in r] for r in exact], bool).reshape(exact.shape)
    return np.where(fits, exact, 0).astype(np.int64), fits


def first_rows(score: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of the rows ``at`` (in the order of their ids) the first ``n`` by falling score, ties by id."""
    s = score[at]
    if len(at) > 4 * n:  # all that tie with the n-th stay in
        near = np.flatnonzero(s >= np.partition(s, len(s) - n)[len(s) - n])
        at, s = at[near], s[near]
    return at[np.argsort(-s.astype(object) if len(s) and s.min() == -TOP else -s, kind="stable")[:n]]


def window_rows(score: np.ndarray, others: np.ndarray, positives: list[int], n: int, low: tuple[int, int], high: tuple[int, int]) -> set[int]:
    """Of the rows ``others`` the first ``n`` within each positive's window."""
    found: set[int] = set()
    s = score[others]
    for p in positives:
        bottom, top = -(-low[0] * p // low[1]), high[0] * p // high[1]  # whole bounds of the window
        if bottom <= top:
            found.update(first_rows(score, others[(s >= bottom) & (s <= top)], n).tolist())
    return found


def vectors(df: DataFrame, key: str, vector: str, label: str, relabel: int = 0, labels: int = 0) -> DataFrame:
    """(id, label, v, dim) of the rows that take part; components as whole numbers in doubles."""
    v = F.col(vector).cast("array<double>")
    d = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("x"))
    # floor of a double as a double: beyond 2**52 every double is whole already
    whole = F.transform("x", lambda c: F.when(F.abs(c) < float(1 << 44), F.floor(c * 256).cast("double")).otherwise(c * 256))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**1015))
    d = d.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(finite)
    if relabel:
        d = d.withColumn("label", F.when(F.col("id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
    return d.select("id", "label", whole.alias("v"), F.size("x").alias("dim"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dim)


def blocks(rows: DataFrame, anchors: DataFrame, body, schema: str, row_block: int, anchor_block: int) -> DataFrame:
    """``body(key, rows, anchors)`` over every pair of a block of rows and a block of anchors."""
    spark = rows.sparkSession
    n, m = (max(1, -(-df.count() // size)) for df, size in ((rows, row_block), (anchors, anchor_block)))
    place = F.xxhash64(F.monotonically_increasing_id())  # of a written table, so a task that runs again finds the same
    r = rows.withColumn("rb", F.pmod(place, F.lit(n))).withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>")))
    a = anchors.withColumn("ab", F.pmod(F.xxhash64("id"), F.lit(m))).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")))
    parts = partitions(spark, min(n * m, 4 * partitions(spark)))
    both = [df.repartition(parts, "dim", "rb", "ab").groupBy("dim", "rb", "ab") for df in (r, a)]
    return both[0].cogroup(both[1]).applyInArrow(body, schema)


def _scored(key, rows: pa.Table, anchors: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each anchor of a group: (anchor's number, scores, ids, same label, other label); rows in the order of their ids."""
    if not rows.num_rows or not anchors.num_rows:
        return
    dim = key[0].as_py()
    rows = rows.sort_by("id")
    ids, labels, v = rows.column("id").to_numpy(), rows.column("label").to_numpy(), _matrix(rows.column("v"), dim)
    a_ids, a_labels, a_v = anchors.column("id").to_numpy(), anchors.column("label").to_numpy(), _matrix(anchors.column("v"), dim)
    by_label = {x: np.flatnonzero(labels == x) for x in np.unique(a_labels).tolist()}
    other_label = {x: np.flatnonzero(labels != x) for x in by_label}
    for at in range(0, len(a_ids), SLICE):
        score, fits = scores(a_v[at : at + SLICE], v)
        for k in range(len(score)):
            i, x = at + k, int(a_labels[at + k])
            same, other = by_label[x], other_label[x]
            same, other = same[ids[same] != a_ids[i]], other[ids[other] != a_ids[i]]
            if fits is not None:
                same, other = same[fits[k][same]], other[fits[k][other]]
            yield i, score[k], ids, same, other


def _out(found: list[tuple[int, int, int]]) -> pa.Table:
    """(anchor, score, id) rows."""
    columns = zip(*found) if found else ([], [], [])
    return pa.table(dict(zip(("anchor", "score", "row"), (pa.array(list(c), pa.int64()) for c in columns))))


def best_positives(rows: DataFrame, anchors: DataFrame, n: int, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """(anchor, score, row): of each block of rows, an anchor's first ``n`` of its own label."""

    def body(key, r, a):
        who = a.column("id").to_pylist()
        return _out([(who[i], int(s[j]), int(ids[j])) for i, s, ids, same, _ in _scored(key, r, a) for j in first_rows(s, same, n).tolist()])

    return blocks(rows, anchors, body, "anchor long, score long, row long", row_block, anchor_block)


def window_negatives(
    rows: DataFrame, anchors: DataFrame, n: int, low: tuple[int, int], high: tuple[int, int], row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK
) -> DataFrame:
    """(anchor, score, row): of each block of rows, the first ``n`` of another label in each window of the anchor's ``positives``."""

    def body(key, r, a):
        who, wanted = a.column("id").to_pylist(), a.column("positives").to_pylist() if a.num_rows else []
        found = []
        for i, s, ids, _, other in _scored(key, r, a):
            found += [(who[i], int(s[j]), int(ids[j])) for j in window_rows(s, other, wanted[i], n, low, high)]
        return _out(found)

    return blocks(rows, anchors, body, "anchor long, score long, row long", row_block, anchor_block)


def stream_windows(
    keys: Iterator[tuple[bytes, bool]], positives: int = POSITIVES, negatives: int = NEGATIVES, low: tuple[int, int] = LOW, high: tuple[int, int] = HIGH
) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Sorted (key, is a positive) -> (anchor, positive, rank, negative, positive's score, negative's score)."""
    now, opened, windows, zeros = None, 0, [], []
    for key, positive in keys:
        anchor, score, row = unpack(key)
        if anchor != now:
            now, opened, windows, zeros = anchor, 0, [], []
        if positive:
            if opened == positives:
                continue
            opened += 1
            if score < 0:  # nothing lies between half of it and nearly all of it
                continue
            window = [row, score, 0]
            if score == 0:
                for z in zeros:
                    window[2] += 1
                    yield anchor, row, window[2], z, 0, 0
            windows.append(window)
        else:
            if score == 0 and len(zeros) < negatives:
                zeros.append(row)
            for w in windows:
                if w[2] < negatives and in_window(w[1], score, low, high):
                    w[2] += 1
                    yield anchor, w[0], w[2], row, w[1], score
        windows = [w for w in windows if w[2] < negatives and low[0] * w[1] <= low[1] * score]  # full, or the scores have passed it


def _by_anchor(key: bytes) -> int:
    return zlib.crc32(key[:8])


def mine(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: tuple[int, int] = LOW, high: tuple[int, int] = HIGH, relabel: int = 7, labels: int = 10, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by ``every``, one row per anchor, positive and rank."""
    spark = df.sparkSession
    rows = materialise(vectors(df, key, vector, label, relabel, labels), "negatives-rows")
    first = F.min(F.struct("label", "v", "dim")).alias("f")
    anchors = materialise(rows.where(F.col("id") % every == 0).groupBy("id").agg(first).select("id", "f.label", "f.v", "f.dim"), "negatives-anchors")
    best = best_positives(rows, anchors, positives, row_block, anchor_block)
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "row"))  # of ``positives`` rows a block
    best = materialise(best.withColumn("nth", rank).where(F.col("nth") <= positives).drop("nth"), "negatives-positives")
    wanted = best.groupBy(F.col("anchor").alias("id")).agg(F.collect_list("score").alias("positives"))
    open_ = materialise(anchors.join(wanted, "id"), "negatives-windows")
    near = window_negatives(rows, open_, negatives, low, high, row_block, anchor_block)
    sent = best.withColumn("positive", F.lit(True)).unionByName(near.withColumn("positive", F.lit(False)))
    keyed = sent.rdd.map(lambda r: (pack(r[0], r[1], r[2]), r[3]))
    dealt = keyed.repartitionAndSortWithinPartitions(partitions(spark), _by_anchor)
    out = dealt.mapPartitions(lambda part: stream_windows(part, positives, negatives, low, high))
    return spark.createDataFrame(out, OUTPUT, verifySchema=False)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
    CAST(list_sum(list_transform(list_zip(a.q, r.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id AND len(a.q) = len(r.q) WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@register("op12_hard_negatives", ORACLE)
def op12_hard_negatives(spark, sf_dir):
    return mine(table(spark, sf_dir, "embeddings"))
