"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within ``2r`` bits of each other have a common variant within ``r`` bits of both.  Every distinct
fingerprint therefore emits all variants within half the radius; variants meet by value, colliding pairs are checked by
their bit distance, and links become components.

A fingerprint has 2,081 variants at r = 2, so they are not shuffled one by one: a variant's shuffle key is
the parity of each of ``n`` bit groups, and flipping up to two bits changes up to two parities.  A fingerprint is sent once to each key that any
of its variants has (1 + n + n(n-1)/2 keys), and the task of a key builds the variants of that key only.  Variants
with one value always have one key, so none is missed.  Bit groups mix all bits, so a crowd of near copies, which differ in a few bits,
is spread over many keys.  Within a task, links are a spanning forest: each fingerprint is linked to one root, not to
all its partners.

Defined cases: null text counts as empty; texts without words have fingerprint zero, linked like any other; equal fingerprints
are one class; texts are read whole; a null id takes part in its class, and a class's id is its smallest id that is not null;
repeated rows are rows of one class; an empty table gives an empty result; columns other than those named are not read, so their names can't clash, and
``keep_representatives`` passes them through.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.base import arrow_rows, fresh_name, materialise, partitions
from starlens.llm.components import components
from starlens.llm.registry import register, table

SHINGLE = 4
DISTANCE = 4  # most differing bits of a link
SEED = 42  # of the shingle hash
KEY_VARIANTS = 1 << 24  # variants a key should hold; sets the number of bit groups
SLICE_VARIANTS = 1 << 22  # variants a task builds at a time


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint: a bit is set when it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        value = xxhash.xxh64_intdigest(b" ".join(words), SEED)
        return value - (1 << 64) if value >> 63 else value
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops[shingle - 1 :])), np.uint64, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):  # bits of a slice at a time: a long text's bit table stays small
        counts += np.unpackbits(h[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])
    body = arrow_rows(lambda k, t: {"id": k, "fp": simhash(t, shingle)}, schema)
    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(body, "id long, fp long")


def groups_needed(n: int, radius: int) -> int:
    """Bit groups for ``n`` fingerprints: keys hold about KEY_VARIANTS variants each."""
    ball = sum(math.comb(64, k) for k in range(radius + 1))
    return min(24, max(6, math.ceil(math.log2(max(1, n * ball / KEY_VARIANTS)))))


def group_masks(groups: int) -> list[int]:
    """Bit ``i`` belongs to group ``i mod groups``."""
    return [sum(1 << i for i in range(64) if i % groups == g) for g in range(groups)]


def flips(radius: int, groups: int) -> dict[int, np.ndarray]:
    """Bit flips of at most ``radius`` bits, by the change of the key."""
    out: dict[int, list[int]] = {}
    for k in range(radius + 1):
        for bits in combinations(range(64), k):
            change = 0
            for i in bits:
                change ^= 1 << (i % groups)
            out.setdefault(change, []).append(sum(1 << i for i in bits))
    return {c: np.array(v, np.uint64) for c, v in out.items()}


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, for nodes 0..n-1 and links u-v."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        if not len(u):
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def key_links(fps: np.ndarray, key: int, groups: int, by_change: dict[int, np.ndarray], radius: int, at_once: int = SLICE_VARIANTS) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of the fingerprints that share a variant of this key."""
    fps = np.unique(fps)
    own = np.zeros(len(fps), np.int64)
    for g, mask in enumerate(group_masks(groups)):
        own |= (np.bitwise_count(fps & np.uint64(mask)).astype(np.int64) & 1) << g
    near_key = np.isin(own ^ key, list(by_change))
    fps, change = fps[near_key], (own ^ key)[near_key]
    order = np.argsort(change, kind="stable")
    kinds, first = np.unique(change[order], return_index=True)
    last = np.append(first[1:], len(order))
    us, vs = [], []
    slices = 1 + sum((b - a) * len(by_change[c]) for c, a, b in zip(kinds.tolist(), first.tolist(), last.tolist())) // at_once
    order = order.astype(np.int32)
    for part in range(slices):
        values, index = [], []
        for c, a, b in zip(kinds.tolist(), first.tolist(), last.tolist()):
            at = order[a:b]
            var = (fps[at][:, None] ^ by_change[c][None, :]).ravel()
            who = np.repeat(at, len(by_change[c]))
            if slices > 1:  # a variant's slice is a hash of its value, so equal variants meet in one slice
                here = ((var * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(slices) == part
                var, who = var[here], who[here]
            values.append(var)
            index.append(who)
        value, who = np.concatenate(values), np.concatenate(index)
        o = np.argsort(value)
        value, who = value[o], who[o]
        same = value[1:] == value[:-1]
        a, b = who[:-1][same], who[1:][same]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= 2 * radius  # the check of each colliding pair
        us.append(a[near])
        vs.append(b[near])
    label = forest(len(fps), np.concatenate(us), np.concatenate(vs))
    member = np.flatnonzero(label != np.arange(len(fps)))
    return fps[member], fps[label[member]]


def ball_links(fps: DataFrame, distance: int = DISTANCE, groups: int | None = None) -> DataFrame:
    """(fp) distinct -> links (a, b) that connect all fingerprints within ``distance`` bits."""
    if distance % 2:
        raise ValueError("an odd distance has no middle; take the next even one and filter")
    radius = distance // 2
    groups = groups or groups_needed(fps.count(), radius)
    by_change = flips(radius, groups)
    changes = sorted(by_change)
    own = F.lit(0)
    for g, mask in enumerate(group_masks(groups)):
        signed = mask - (1 << 64) if mask >> 63 else mask
        own = own.bitwiseOR(F.shiftleft((F.bit_count(F.col("fp").bitwiseAND(F.lit(signed).cast("long"))) % 2).cast("int"), g))
    sent = fps.select("fp", own.alias("own")).select("fp", F.explode(F.transform(F.array(*map(F.lit, changes)), lambda c: c.bitwiseXOR(F.col("own")))).alias("key"))

    def body(key, part):
        f = part.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        a, b = key_links(f, key[0].as_py(), groups, by_change, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    n = partitions(fps.sparkSession, min(1 << groups, 4 * partitions(fps.sparkSession)))
    return sent.repartition(n, "key").groupBy("key").applyInArrow(body, "a long, b long")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: id, fp, component_id."""
    d = materialise(fingerprints(docs, key, text, shingle), "simhash")
    classes = materialise(d.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    links = ball_links(classes.select("fp"), distance)
    roots = materialise(components(links), "simhash-roots")
    linked = classes.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = materialise(linked, "simhash-linked")
    least = materialise(linked.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    named = materialise(linked.join(least, "root").select("fp", "component_id"), "simhash-named")
    return d.join(named, "fp").select("id", "fp", "component_id")


def keep_representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, with their columns; of repeated rows of that id, one."""
    stay = fresh_name(docs, "stay_id")
    ids = near_groups(docs, key, text, **options)
    kept = ids.select(F.col("component_id").alias(stay)).distinct()
    out = docs.join(kept, F.col(key).eqNullSafe(F.col(stay)), "left_semi")
    if not ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        out = out.dropDuplicates([key])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


@register("op8_simhash_balls")
def op8_simhash_balls(spark, sf_dir):
    g = near_groups(table(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
