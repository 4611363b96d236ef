"""Filter interaction audit: what each of several filters removes, in every order in which they could be applied.

A document is reduced to the mask of the filters that it fails; the counts of a part's masks say everything about all orders.  Orders are
numbered by their Lehmer rank (lexicographic order).  A mask is removed at step ``s`` in exactly the orders whose first
``s - 1`` letters it passes and whose ``s``-th letter it fails; all orders with one such beginning have consecutive ranks.  So a mask
adds its count at the first rank of each of those intervals and takes it off behind the last one, and a prefix sum over the ranks of a step
gives the removals in all orders at once.

One filter needs the whole table: a document fails it when a smaller id has the same text.  Texts travel as SHA-256
digests.  A digest's rows are counted per part and mask before they meet, with the smallest id and its rows beside the count, so a text that
a third of all rows share is a few rows per task.

Defined cases: null text counts as empty, null part as the empty string; the empty text has no words and fails ``A`` only (and ``E`` where a
smaller id is empty); texts are read whole, at any length; a row without an id never fails ``E`` and makes no other row fail it; rows
that repeat an id and text are counted each, and none of them is smaller than the others; a document without labels is neither good nor
toxic, and of repeated label rows any 1 counts; an empty table gives an empty result; columns other than those named are not read, so
their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.base import arrow_rows, materialise
from starlens.llm.registry import register, table

FILTERS = "ABCDE"
MARKS = b"#$%&*|"  # what filter D looks for
UPPER = bytes(range(ord("A"), ord("Z") + 1))
TABLE_WIDE = "E"  # judged by join, the others by the text alone
OUTPUT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def own_mask(text: str | None) -> tuple[int, bytes]:
    """Bits of the filters that a text fails by itself (A is bit 0), and its digest."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    mask = len(words) < 200
    mask |= (100 * len(set(words)) < 50 * len(words)) << 1
    mask |= (100 * (len(raw) - len(raw.translate(None, UPPER))) > 3 * len(text)) << 2
    mask |= (len(raw.translate(None, MARKS)) < len(raw)) << 3
    return int(mask), hashlib.sha256(raw).digest()


def intervals(mask: int, filters: str = FILTERS) -> Iterator[tuple[int, int, int]]:
    """(step, first rank, rank behind the last) of the orders in which a document of this mask goes at that step (from 0)."""
    k = len(filters)

    def walk(step: int, rest: list[int], rank: int) -> Iterator[tuple[int, int, int]]:
        width = factorial(k - 1 - step)
        for i, f in enumerate(rest):  # digit i of the Lehmer code
            at = rank + i * width
            if mask >> f & 1:
                yield step, at, at + width
            else:
                yield from walk(step + 1, rest[:i] + rest[i + 1 :], at)

    if mask:
        yield from walk(0, list(range(k)), 0)


def audit_part(masks: np.ndarray, counts: np.ndarray, filters: str = FILTERS) -> dict[str, list]:
    """All orders and steps of one part; ``counts`` has a row (documents, good, toxic) for each mask."""
    k, orders = len(filters), ["".join(p) for p in permutations(filters)]
    diff = np.zeros((3, k, len(orders) + 1), np.int64)
    for m, c in zip(masks.tolist(), counts):
        for step, start, end in intervals(m, filters):
            diff[:, step, start] += c
            diff[:, step, end] -= c
    removed, good, toxic = diff.cumsum(axis=2)[:, :, :-1]  # (step, rank)
    kept = int(counts[:, 0].sum()) - removed.cumsum(axis=0)
    fails = [int(counts[masks >> f & 1 == 1, 0].sum()) for f in range(k)]
    only = [int(counts[masks == 1 << f, 0].sum()) for f in range(k)]
    letter = np.array([[filters.index(x) for x in o] for o in orders]).T  # (step, rank)
    shapley = [int(removed[letter == f].sum()) for f in range(k)]
    out: dict[str, list] = {n: [] for n in ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}
    for rank, order in enumerate(orders):
        for step in range(k):
            f, gone = int(letter[step, rank]), int(removed[step, rank])
            row = (order, step + 1, int(kept[step, rank]), gone, fails[f] - gone, only[f], int(good[step, rank]), int(toxic[step, rank]), shapley[f])
            for values, v in zip(out.values(), row):
                values.append(v)
    return out


def document_masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, how many are labelled good and toxic."""
    schema = pa.schema([("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("digest", pa.binary())])

    def judge(k, p, t):
        mask, digest = own_mask(t)
        return {"id": k, "part": p, "mask": mask, "digest": digest}

    named = docs.select(F.col(key).cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")), F.col(text).cast("string"))
    d = named.mapInArrow(arrow_rows(judge, schema), "id long, part string, mask int, digest binary")
    d = d.groupBy("id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    d = d.join(marked, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # per text: rows, rows without an id, and the smallest id with its rows
    texts = d.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
    )
    texts = materialise(texts, "audit-texts")
    least = texts.groupBy("digest").agg(F.min("first.id").alias("least"))
    here = F.coalesce(F.when(F.col("first.id") == F.col("least"), F.col("first.n")), F.lit(0))
    both = texts.join(least, "digest").withColumn("stay", F.col("no_id") + here)
    bit = 1 << FILTERS.index(TABLE_WIDE)
    sides = F.array(F.struct(F.col("mask"), F.col("stay").alias("n")), F.struct(F.col("mask").bitwiseOR(bit).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))
    one = both.select("part", "good", "toxic", F.explode(sides).alias("x")).select("part", "good", "toxic", "x.mask", "x.n")
    return one.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, mask, n, good, toxic) -> one row per part, order of the filters and step."""

    def body(key, rows):
        counts = np.stack([rows.column(c).to_numpy() for c in ("n", "good", "toxic")], axis=1)
        out = audit_part(rows.column("mask").to_numpy().astype(np.int64), counts, filters)
        return pa.table({"part": pa.array([key[0].as_py()] * len(out["step"]), pa.string()), **out}).cast(schema)

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in OUTPUT.split(", "))])
    return masks.groupBy("part").applyInArrow(body, OUTPUT)  # at most 2 ** filters rows a part


ORACLE = """
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN lab ON w.doc_id = lab.doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o),
b AS (
  SELECT filter_order, step, CAST(1 << (ascii(substr(filter_order, step, 1)) - 65) AS INTEGER) AS bit,
    CAST(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, CAST(i AS INTEGER), 1)) - 65))) AS INTEGER) AS before
  FROM s),
r AS (
  SELECT part, filter_order, step, bit,
    CAST(sum(CASE WHEN mask & (bit | coalesce(before, 0)) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM m, b GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""


@register("op13_filter_audit", ORACLE)
def op13_filter_audit(spark, sf_dir):
    return audit(document_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
