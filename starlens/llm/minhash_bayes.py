"""MinHash near-dedup with sequential Bayesian verification.

Equal shingle sets are one class, so a crowd of copies is one entry from here on.  Classes that agree in all hashes of a signature band meet
in a bucket.  In a bucket, pairs are compared batch by batch of their signatures: after each batch the posterior of their similarity (uniform
prior, so a beta distribution) gives the probability that it still reaches the threshold, and a pair below the chosen miss probability is dropped.
Survivors are verified on full shingle sets.

Pairs stay inside the task that compares them.  A bucket sends on a maximum spanning forest of its survivors, weighed by their
agreement: members less one, not all pairs.  Large buckets are cut into blocks; each block does so by itself and names its medoid, and all
members of the bucket are compared with the best medoid too.  After the verification most buckets lie in one component and are done.  In
the others every surviving pair across components that was not a forest's is verified in the bucket's task, likeliest first, against the component
graph so far: members outside the bucket's largest component meet all members, block by block.  So no link between components is lost but
to the two stated probabilities: a pair at the threshold shares no band (``MISS`` bounds it by the choice of the bands) or is pruned.

Defined cases: null text counts as empty; a text of fewer words than a shingle is one shingle, a text without words has none and is linked with nothing;
texts are read whole; equal sets are linked whatever their order of words; a null id takes part in its class, and a component's id is
its smallest id that is not null (null where all are); repeated rows are rows of one class; an empty table gives an empty result; columns other than
those named are not read, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.base import arrow_rows, fresh_name, materialise, numbered, partitions
from starlens.llm.components import components
from starlens.llm.registry import register, table

SHINGLE = 3  # words
PERCENT = 85  # least similarity of a link
HASHES = 125  # of a signature
BATCH = 25  # hashes compared between two looks at the posterior
MISS = 1e-6  # chosen probability of losing a pair at the threshold
BLOCK = 512  # members of a bucket that are compared with each other in one task
SEED = 11
CACHE_WORDS = 200_000
SIG = "<u2"  # a hash of a signature

_rng = np.random.default_rng(SEED)
FACTORS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


class WordHashes(dict):
    """Hashes of words, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def shingle_set(text: str | None, shingle: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - shingle + 1
    z = np.zeros(n, np.uint64)
    for i in range(shingle):  # the order of the words matters
        z = (z ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(29)
    return np.unique(z)


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[at : at + 512, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    # 16 mixed bits of each minimum: unequal minima agree once in 65,536, which can only keep a pair for the verification
    least = (least ^ (least >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (least >> np.uint64(48)).astype(SIG)


def banding(percent: int, miss: float = MISS) -> int:
    """Hashes a band: as many as keep the probability that a pair at the threshold shares no band below ``miss``."""
    t = percent / 100
    for rows in range(BATCH, 0, -1):
        if (1 - t**rows) ** (HASHES // rows) <= miss:
            return rows
    raise ValueError(f"{HASHES} hashes are too few for {percent} % at a miss probability of {miss}")


def least_matches(percent: int, miss: float = MISS) -> list[int]:
    """After each batch, the fewest matches with which the similarity still reaches the threshold with probability ``miss`` or more."""
    t, out = percent / 100, []
    for seen in range(BATCH, HASHES + 1, BATCH):
        # posterior Beta(m + 1, seen - m + 1): above t with the probability that Binomial(seen + 1, t) is at most m
        p, m = 0.0, 0
        while (p := p + math.comb(seen + 1, m) * t**m * (1 - t) ** (seen + 1 - m)) < miss:
            m += 1
        out.append(m)
    return out


def survivors(sig: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int, least: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (i, j) those that no batch prunes, with their matches."""
    out = []
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        near = 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])  # else the sizes alone forbid it
        a, b = a[near], b[near]
        m = np.zeros(len(a), np.int64)
        for k, enough in enumerate(least):
            part = slice(k * BATCH, (k + 1) * BATCH)
            m += (sig[a, part] == sig[b, part]).sum(axis=1)
            stay = m >= enough
            a, b, m = a[stay], b[stay], m[stay]
        out.append((a, b, m))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def forest(n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> list[tuple[int, int]]:
    """Maximum spanning forest of the weighted pairs among 0..n-1."""
    w = np.full((n, n), -1, np.int64)
    w[i, j] = w[j, i] = weight
    best, parent, free = np.full(n, -1), np.zeros(n, np.int64), np.ones(n, bool)
    out = []
    for _ in range(n):
        v = int(np.argmax(np.where(free, best, -2)))
        if best[v] >= 0:
            out.append((int(parent[v]), v))
        free[v] = False
        closer = w[v] > best
        best[closer], parent[closer] = w[v][closer], v
    return out


def medoid(sig: np.ndarray) -> tuple[int, float]:
    """The member that agrees most with the others, and its mean agreement."""
    score = np.zeros(len(sig))
    for c in sig.T:
        _, which, n = np.unique(c, return_inverse=True, return_counts=True)
        score += n[which]
    v = int(np.argmax(score))
    return v, float(score[v]) / len(sig)


def _arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {}
    for name, c in zip(batch.schema.names, batch.columns):
        if name == "sig":
            out[name] = np.frombuffer(b"".join(c.to_pylist()), SIG).reshape(len(c), HASHES)
        elif pa.types.is_binary(c.type):
            out[name] = np.array([*c.to_pylist(), None], object)[:-1]
        else:
            out[name] = c.to_numpy(zero_copy_only=False)
    return out


def runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each value of ``by``, from batches sorted by it."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        now = _arrays(batch)
        now = {c: np.concatenate([held[c], v]) for c, v in now.items()} if held else now
        change = np.logical_or.reduce([now[c][1:] != now[c][:-1] for c in by])
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield {c: v[a:b] for c, v in now.items()}
        held = {c: v[cuts[-1] :] for c, v in now.items()}
    if held:
        yield held


def _emit(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, zip(*held)), schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= at_once:
            yield batch()
            held = []
    if held:
        yield batch()


def sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """(row, id, text) -> (row, id, n, digest, sig); digest names the set."""
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])
    hashes = WordHashes()

    def sketch(row, key, text):
        s = shingle_set(text, shingle, hashes)
        return {"row": row, "id": key, "n": len(s), "digest": xxhash.xxh3_128_digest(s.tobytes()), "sig": signature(s).tobytes()}

    return texts.select("row", "id", "text").mapInArrow(arrow_rows(sketch, schema), "row long, id long, n long, digest binary, sig binary")


def entries(classes: DataFrame, rows: int) -> DataFrame:
    """(cid, sig) -> (key, cid), one row for each band."""
    bands = HASHES // rows

    def body(batches):
        for batch in batches:
            sig = _arrays(batch)["sig"].astype(np.uint64)
            key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
            for r in range(rows):
                key = (key ^ sig[:, r : rows * bands : rows]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), bands))], ["key", "cid"])

    return classes.select("cid", "sig").mapInArrow(body, "key long, cid long")


def bucket_forests(members: DataFrame, percent: int) -> DataFrame:
    """(key, block, blocks, cid, n, sig) -> pairs to verify (kind 0), and per cell its medoid (kind 1: a, score) and whether its pairs are all there (b)."""
    least = least_matches(percent)
    schema = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())])

    def rows(batches):
        for c in runs(batches, ["key", "block"]):
            m, key, whole = len(c["cid"]), int(c["key"][0]), int(c["blocks"][0]) == 1
            i, j, w = survivors(c["sig"], c["n"], *np.triu_indices(m, 1), percent, least)
            tree = forest(m, i, j, w) if len(i) > 1 else list(zip(i.tolist(), j.tolist()))
            for a, b in tree:
                yield key, 0, *sorted((int(c["cid"][a]), int(c["cid"][b]))), 0.0
            if not whole:
                v, score = medoid(c["sig"])
                yield key, 1, int(c["cid"][v]), 0, score
            elif len(tree) < len(i):
                yield key, 1, int(c["cid"][0]), 0, 0.0

    p = partitions(members.sparkSession)
    dealt = members.select("key", "block", "blocks", "cid", "n", "sig").repartition(p, "key", "block").sortWithinPartitions("key", "block", "cid")
    return dealt.mapInArrow(lambda batches: _emit(rows(batches), schema), "key long, kind int, a long, b long, score double")


def star_pairs(members: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """All members of a cut bucket against its best medoid -> surviving (a, b)."""
    least = least_matches(percent)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    best = cells.groupBy("key").agg(F.max_by("a", "score").alias("cid"))
    pivot = best.join(members, ["key", "cid"]).select("key", F.col("cid").alias("pivot"), F.col("n").alias("pivot_n"), F.col("sig").alias("pivot_sig"))
    pivot = materialise(pivot, "minhash-pivots")

    def body(batches):
        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            sig = [np.frombuffer(b"".join(c[x].to_pylist()), SIG).reshape(batch.num_rows, HASHES) for x in ("sig", "pivot_sig")]
            size = np.concatenate([c["n"].to_numpy(), c["pivot_n"].to_numpy()])
            at = np.arange(batch.num_rows)
            i, _, _ = survivors(np.concatenate(sig), size, at, at + batch.num_rows, percent, least)
            a, b = c["cid"].to_numpy()[i], c["pivot"].to_numpy()[i]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

    both = members.where("blocks > 1").select("key", "cid", "n", "sig").join(pivot, "key").where("cid <> pivot")
    return both.select("cid", "n", "sig", "pivot", "pivot_n", "pivot_sig").mapInArrow(body, "a long, b long")


def is_link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sets_of(texts: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """(row, shingles) of the texts whose row is in ``rows`` (row); planned alike at every size, as the rows grow with the texts."""
    schema = pa.schema([("row", pa.int64()), ("shingles", pa.binary())])
    hashes = WordHashes()
    body = arrow_rows(lambda row, text: {"row": row, "shingles": shingle_set(text, shingle, hashes).tobytes()}, schema)
    wanted = texts.select("row", "text").join(rows.distinct().hint("merge"), "row", "left_semi")
    return materialise(wanted.mapInArrow(body, "row long, shingles binary"), "minhash-sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def judge(a, b, x, y):
        return {"a": a, "b": b} if is_link(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) else None

    side = lambda n: sets.select(F.col("row").alias(n), F.col("shingles").alias(f"s{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(arrow_rows(judge, schema), "a long, b long")


def open_cells(members: DataFrame, roots: DataFrame, keys: DataFrame, block: int) -> DataFrame:
    """Members of buckets ``keys`` that still hold several components, dealt to cells: those outside the largest one (left) meet all (right)."""
    m = members.join(keys, "key", "left_semi").join(roots.select(F.col("id").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    m = materialise(m.select("key", "cid", "n", "sig", "root"), "minhash-open")
    sizes = m.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("in_main"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("kinds"))
    main = main.where("kinds > 1").select("key", "main", F.ceil((F.col("all") - F.col("in_main")) / block).alias("lb"), F.ceil(F.col("all") / block).alias("rb"))
    m = m.join(materialise(main, "minhash-main"), "key").withColumn("out", F.col("root") != F.col("main"))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("cid"), F.col(n))
    left = m.where("out").withColumn("i", place("lb")).withColumn("j", spread("rb")).withColumn("side", F.lit(0))
    right = m.withColumn("j", place("rb")).withColumn("i", spread("lb")).withColumn("side", F.lit(1))
    columns = ["key", "i", "j", "side", "cid", "n", "root", "out", "sig"]
    return left.select(*columns).unionByName(right.select(*columns))


def cell_links(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components, found in each cell by verifying its surviving pairs, likeliest first."""
    least = least_matches(percent)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows(batches):
        for c in runs(batches, ["key", "i", "j"]):
            left, right = np.flatnonzero(c["side"] == 0), np.flatnonzero(c["side"] == 1)
            label = {int(r): int(r) for r in np.unique(c["root"])}

            def find(x):
                while label[x] != x:
                    label[x] = x = label[label[x]]
                return x

            found = []
            for l in left.tolist():
                # a pair outside the main component is met from both sides: once is enough
                other = right[(c["root"][right] != c["root"][l]) & ~(c["out"][right] & (c["cid"][right] < c["cid"][l]))]
                found.append(survivors(c["sig"], c["n"], np.full(len(other), l), other, percent, least))
            i, j, w = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            for k in np.argsort(-w, kind="stable").tolist():
                a, b = find(int(c["root"][i[k]])), find(int(c["root"][j[k]]))
                if a != b and is_link(np.frombuffer(c["shingles"][i[k]], np.uint64), np.frombuffer(c["shingles"][j[k]], np.uint64), percent):
                    label[max(a, b)] = min(a, b)
                    yield int(c["cid"][i[k]]), int(c["cid"][j[k]])

    both = cells.join(sets.select(F.col("row").alias("cid"), "shingles"), "cid").select("key", "i", "j", "side", "cid", "n", "root", "out", "sig", "shingles")
    p = partitions(cells.sparkSession)
    dealt = both.repartition(p, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "cid")
    return dealt.mapInArrow(lambda batches: _emit(rows(batches), schema), "a long, b long")


def class_links(classes: DataFrame, texts: DataFrame, shingle: int, percent: int, block: int = BLOCK) -> DataFrame:
    """(cid, n, sig) of distinct sets -> (id, root) of the linked ones."""
    bands = materialise(entries(classes, banding(percent)), "minhash-bands")
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    buckets = materialise(buckets.select("key", F.ceil(F.col("c") / block).alias("blocks")), "minhash-buckets")
    members = bands.join(buckets, "key").join(classes.select("cid", "n", "sig"), "cid")
    members = materialise(members.select("key", F.pmod(F.xxhash64("cid"), F.col("blocks")).alias("block"), "blocks", "cid", "n", "sig"), "minhash-members")
    found = materialise(bucket_forests(members, percent), "minhash-forests")
    pairs = found.where("kind = 0").select("a", "b")
    cells = found.where("kind = 1").select("key", "a", "score")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("row"))
    if not members.where("blocks > 1").isEmpty():
        cut = members.where("blocks > 1")
        pairs = pairs.unionByName(star_pairs(members, cells.join(cut.select("key").distinct(), "key", "left_semi"), percent))
        needed = needed.unionByName(cut.select(F.col("cid").alias("row")))  # their pairs between blocks are still to be looked at
    pairs = materialise(pairs.distinct(), "minhash-pairs")
    sets = sets_of(texts, needed, shingle)
    links = materialise(verified(pairs, sets, percent), "minhash-links")
    roots = materialise(components(links), "minhash-roots")
    # a member without a set has no surviving pair in its bucket
    having = members.join(sets.select(F.col("row").alias("cid")), "cid", "left_semi")
    left = materialise(open_cells(having, roots, cells.select("key").distinct(), max(1, block // 2)), "minhash-cells")
    if left.isEmpty():
        return roots
    more = materialise(cell_links(left, sets, percent), "minhash-links")
    return materialise(components(links.unionByName(more)), "minhash-roots") if not more.isEmpty() else roots


def near_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, n (its distinct shingles), component_id."""
    texts = numbered(docs, key, {"id": F.col(key).cast("long"), "text": F.col(text).cast("string")})
    d = materialise(sketches(texts, shingle), "minhash-sketches")
    classes = d.where("n > 0").groupBy("digest").agg(F.min("id").alias("least"), F.min(F.struct("row", "n", "sig")).alias("first"))
    classes = materialise(classes.select("digest", "least", F.col("first.row").alias("cid"), "first.n", "first.sig"), "minhash-classes")
    roots = class_links(classes, texts, shingle, percent, block)
    linked = classes.select("digest", "least", "cid").join(roots.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    linked = materialise(linked, "minhash-linked")
    least = materialise(linked.groupBy("root").agg(F.min("least").alias("component_id")), "minhash-least")
    named = materialise(linked.join(least, "root").select("digest", "component_id"), "minhash-named")
    with_words = d.where("n > 0").join(named, "digest").select("id", "n", "component_id")
    return with_words.unionByName(d.where("n = 0").select("id", "n", F.col("id").alias("component_id")))


def keep_representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, with their columns; of repeated rows of that id, all."""
    kept = fresh_name(docs, "kept_id")
    ids = near_sets(docs, key, text, **options).where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias(kept)).distinct()
    return docs.join(ids, F.col(key).cast("long").eqNullSafe(F.col(kept)), "left_semi")


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 85 * (x.n + y.n - common)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT k.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, k.doc_id = component_id AS kept FROM k LEFT JOIN n ON k.doc_id = n.doc_id
"""


@register("op11_minhash_bayes", ORACLE)
def op11_minhash_bayes(spark, sf_dir):
    g = near_sets(table(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
