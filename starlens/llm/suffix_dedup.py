"""Suffix-array dedup: every byte covered by a fixed-length string that also starts earlier is removed.

Sorting all suffixes of a corpus would move every byte many times over, so suffixes are sorted only where a repeat is possible.

1.  Anchors.  Of every window of ``LENGTH`` bytes the k-gram of smallest prefix-polynomial hash is its anchor.  The choice depends on
    the window's content alone, so equal windows have equal anchors at equal places; there is about one anchor for 35 bytes.
2.  An anchor hash that occurs once in the corpus anchors no repeat.  Hashes are counted per document group and then by hash.
3.  Occurrences of the other anchors are sent by hash with the bytes of their windows.  Per hash, suffixes from the anchor
    on and, reversed, up to it are sorted by mergesort; a comparison finds the common extension by binary search over prefix
    hashes.  Neighbours' extensions are then verified on the bytes, and a list that fails is sorted by its bytes.  Windows at
    one offset are equal when they fall in one class of both sorted lists; all but the first are repeats.
4.  Repeated windows go back to their documents and the bytes they cover are cut out.

Skew: equal texts are represented by their first row before any of this; occurrences whose windows are all equal to an earlier one's of
the group are settled within the group (a map-side combine).  Anchors of more than ``HOT`` occurrences are sent window by window, keyed by the
window's hash, so that a line or passage that very many documents share leaves at most one row per document group and
window in a task.  All of it is exact.

Documents are shuffled once, by group; the three passes over them share that exchange.

Defined cases: null counts as the empty text; texts below ``LENGTH`` bytes lose nothing; earlier means a smaller id, then (rows of one
id) an earlier row number, then an earlier start; a null id comes first; texts of any
length are read whole; an empty table gives an empty result; columns other than those named are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.base import materialise, numbered, partitions
from starlens.llm.registry import register, table

LENGTH = 100  # bytes of a repeated string
GRAM = 32  # bytes of an anchor
GROUP_BYTES = 8 << 20  # text of a document group
COUNT_BYTES = 64 << 20  # text whose anchors are counted in one task
SORT_BYTES = 4 << 20  # text whose repeated anchors are sorted in one task
HOT = 4096  # occurrences from which an anchor is sent window by window
PIECE = 1 << 18  # window starts hashed at a time
CHUNK = 1 << 16  # occurrences whose bytes are gathered at a time

_rng = np.random.Generator(np.random.PCG64(7))
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)  # value of a byte in the polynomial
BASE = 0x9E3779B97F4A7C15
LANES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWER = _powers(BASE, PIECE + LENGTH + 1)
INVERSE = _powers(pow(BASE, -1, 1 << 64), PIECE + LENGTH + 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        key = np.minimum(key[:-done], key[done:])
        done *= 2
    return np.minimum(key[: len(key) - (width - done)], key[width - done :]) if width > done else key


def anchors(buf: np.ndarray, valid: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(hash, position, first start, last start) of the anchors of all windows whose start is ``valid``."""
    found = []
    for a in range(0, len(buf) - length + 1, PIECE):
        b = min(a + PIECE, len(buf) - length + 1)
        starts = np.flatnonzero(valid[a:b])
        if not len(starts):
            continue
        x = buf[a : b + length - 1]
        prefix = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(BYTE[x] * POWER[: len(x)], out=prefix[1:])
        h = _mix((prefix[gram:] - prefix[:-gram]) * INVERSE[: len(x) - gram + 1])
        # order by hash, then the leftmost place
        key = (h & np.uint64(~0xFFFFF & (2**64 - 1))) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_min(key, length - gram + 1) & np.uint64(0xFFFFF)).astype(np.int64)[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        i = np.flatnonzero(new)
        j = np.append(i[1:], len(starts)) - 1
        found.append((h[at[i]], at[i] + a, starts[i] + a, starts[j] + a))
    if not found:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none, none, none
    return tuple(map(np.concatenate, zip(*found)))


def occurrence_bytes(buf: np.ndarray, pos: np.ndarray, near: np.ndarray, far: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each anchor the bytes from ``far`` before it to ``length - near`` after its start, zero elsewhere."""
    left = length - gram
    span = np.arange(-left, length)
    out = buf[np.clip(pos[:, None] + span, 0, len(buf) - 1)]
    out[(span < -far[:, None]) | (span >= length - near[:, None])] = 0
    return out


def row_hash(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of a byte matrix."""
    pad = -rows.shape[1] % 8
    wide = np.pad(rows, ((0, 0), (0, pad))) if pad else np.ascontiguousarray(rows)
    lanes = _mix(wide.view("<u8").astype(np.uint64) + LANES[: wide.shape[1] // 8])
    return _mix((lanes * LANES[: lanes.shape[1]]).sum(axis=1, dtype=np.uint64))


def firsts(h: np.ndarray, near: np.ndarray, far: np.ndarray, data: np.ndarray) -> np.ndarray:
    """True for occurrences that equal no earlier one (arrays are in corpus order) in hash, offsets and bytes."""
    if not len(h):
        return np.zeros(0, bool)
    key = _mix(h ^ _mix(row_hash(data) + near.astype(np.uint64) * np.uint64(131) + far.astype(np.uint64)))
    o = np.argsort(key, kind="stable")
    head = np.ones(len(o), bool)
    head[1:] = key[o][1:] != key[o][:-1]
    lead = o[np.maximum.accumulate(np.where(head, np.arange(len(o)), 0))]  # the run's first occurrence
    same = (h[o] == h[lead]) & (near[o] == near[lead]) & (far[o] == far[lead]) & (data[o] == data[lead]).all(axis=1)
    out = np.zeros(len(o), bool)
    out[o] = head | ~same  # a hash collision stays on its own
    return out


def _extension(prefix: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common extension of rows i and j: binary search over prefix hashes."""
    lo, hi = np.zeros(len(i), np.int64), np.full(len(i), prefix.shape[1] - 1, np.int64)
    for _ in range(int(prefix.shape[1] - 1).bit_length()):
        mid = (lo + hi + 1) >> 1
        same = prefix[i, mid] == prefix[j, mid]
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def suffix_sort(group: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows within each (contiguous) group, and each one's common extension with the one before it (-1: first).

    A bottom-up mergesort over all groups at once: each row finds its place in the neighbouring run by binary search, each comparison
    by ``_extension`` and the next byte.
    """
    n, depth = text.shape
    prefix = np.zeros((n, depth + 1), np.uint64)
    np.cumsum(BYTE[text] * POWER[:depth], axis=1, out=prefix[:, 1:])
    head = np.ones(n, bool)
    head[1:] = group[1:] != group[:-1]
    begin = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    sizes = np.diff(np.append(np.flatnonzero(head), n))
    end = begin + np.repeat(sizes, sizes)
    now, width = np.arange(n), 1
    while width < sizes.max(initial=0):
        slot = np.flatnonzero(end - begin > width)
        run = (slot - begin[slot]) // width
        lo = begin[slot] + (run ^ 1) * width
        hi = np.minimum(lo + width, end[slot])
        has = lo < hi
        slot, run, lo, hi = slot[has], run[has], lo[has], hi[has]
        side, me, right = lo.copy(), now[slot], (run & 1) == 1
        todo = np.arange(len(slot))
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            i, j = now[mid], me[todo]
            d = _extension(prefix, i, j)
            at = np.minimum(d, depth - 1)
            diff = np.where(d == depth, 0, text[i, at].astype(np.int16) - text[j, at])
            before = (diff < 0) | ((diff == 0) & right[todo])
            lo[todo] = np.where(before, mid + 1, lo[todo])
            hi[todo] = np.where(before, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        place = begin[slot] + (run & ~1) * width + (slot - begin[slot]) % width + (lo - side)
        after = now.copy()
        after[place] = me
        now, width = after, 2 * width

    def extensions(order):
        e = np.full(n, -1, np.int64)
        a, b = text[order[:-1]], text[order[1:]]
        differ = a != b
        any_ = differ.any(axis=1)
        first = np.where(any_, differ.argmax(axis=1), depth)
        e[1:] = first
        at = np.minimum(first, depth - 1)[:, None]
        down = any_ & (np.take_along_axis(a, at, 1) > np.take_along_axis(b, at, 1))[:, 0] & ~head[1:]
        e[head] = -1
        return e, not down.any()

    e, sorted_ = extensions(now)
    if not sorted_:  # a hash collision misled a comparison: sort by the bytes themselves
        now = np.lexsort((*text.T[::-1], group))
        e, _ = extensions(now)
    return now, e


def repeated_windows(group: np.ndarray, near: np.ndarray, far: np.ndarray, data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Boolean (occurrence, offset): the window at that offset before the anchor equals an earlier occurrence's.

    Occurrences of one group are contiguous and in corpus order.
    """
    left = length - gram
    n = len(group)
    out = np.zeros((n, left + 1), bool)
    if n < 2:
        return out
    head = np.ones(n, bool)
    head[1:] = group[1:] != group[:-1]
    o_r, e_r = suffix_sort(group, np.ascontiguousarray(data[:, left:]))
    o_l, e_l = suffix_sort(group, np.ascontiguousarray(data[:, left - 1 :: -1] if left else data[:, :0]))
    c_r, c_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(near.min()), int(far.max()) + 1):
        here = np.flatnonzero((near <= o) & (o <= far))
        if len(here) < 2:
            continue
        c_r[o_r] = np.cumsum(e_r < length - o)  # one class: the same length - o bytes from the anchor on
        c_l[o_l] = np.cumsum(e_l < o)  # and the same o bytes before it
        key = c_r[here] * (n + 1) + c_l[here]
        by = np.argsort(key, kind="stable")
        again = np.zeros(len(by), bool)
        again[1:] = key[by][1:] == key[by][:-1]
        out[here[by[again]], o] = True
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, last column) of the runs of True in each row."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    r, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    return r, a, b - 1


class Group:
    """A document group's bytes, without the rows that are copies of an earlier row's text."""

    def __init__(self, docs: pa.Table, copies: set[int], length: int):
        docs = docs.combine_chunks()
        row = docs.column("row").to_numpy()
        keep = np.array([r not in copies for r in row.tolist()], bool) if copies else np.ones(len(row), bool)
        col = docs.column("t").filter(pa.array(keep)).combine_chunks()
        col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
        self.row = row[keep]
        order = np.argsort(self.row, kind="stable")
        self.row, col = self.row[order], col.take(pa.array(order))
        offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = col.buffers()[2]
        self.buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(col) else np.empty(0, np.uint8)
        self.begin = offsets[:-1] - offsets[0] if len(col) else np.empty(0, np.int64)
        self.valid = np.ones(len(self.buf), bool)
        for a, b in zip(self.begin.tolist(), (offsets[1:] - offsets[0]).tolist()):
            self.valid[max(a, b - length + 1) : b] = False

    def document(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, pos, side="right") - 1


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _copies(control: pa.Table) -> set[int]:
    return set(control.column("row").filter(control.column("copy")).to_pylist())


COUNTS = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("h", pa.binary()), ("n", pa.binary())])
WANTED = pa.schema([("g", pa.int64()), ("h", pa.binary()), ("hot", pa.binary())])
FOUND = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("h", pa.binary()), ("row", pa.binary()), ("pos", pa.binary()), ("off", pa.binary()), ("data", pa.binary()), ("cut_row", pa.binary()), ("cut", pa.binary())])
CUTS = pa.schema([("g", pa.int64()), ("row", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
OUT = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def count_anchors(buckets: int, length: int, gram: int):
    """Pass 1 over a document group: its distinct anchor hashes and their counts, by bucket of the hash."""

    def body(key, docs, control):
        g = Group(docs, _copies(control), length)
        h, n = np.unique(anchors(g.buf, g.valid, length, gram)[0], return_counts=True)
        b = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        at = np.flatnonzero(np.diff(b[order], prepend=-1))
        out = {"bucket": [], "g": [], "h": [], "n": []}
        for x, y in zip(at.tolist(), np.append(at[1:], len(order)).tolist()):
            out["bucket"].append(int(b[order[x]]))
            out["g"].append(key[0].as_py())
            out["h"].append(_blob(h[order[x:y]]))
            out["n"].append(_blob(n[order[x:y]].astype(np.uint32)))
        return pa.table(out, schema=COUNTS)

    return body


def wanted_anchors(hot: int):
    """Per bucket: tells each document group which of its anchors occur elsewhere or again, and which are hot."""

    def body(key, part):
        gs = part.column("g").to_pylist()
        hs = [np.frombuffer(x, np.uint64) for x in part.column("h").to_pylist()]
        ns = np.concatenate([np.frombuffer(x, np.uint32) for x in part.column("n").to_pylist()]).astype(np.int64)
        h = np.concatenate(hs)
        values, at = np.unique(h, return_inverse=True)
        total = np.bincount(at, weights=ns, minlength=len(values))[at]
        out, begin = {"g": [], "h": [], "hot": []}, 0
        for g, x in zip(gs, hs):
            t = total[begin : begin + len(x)]
            begin += len(x)
            again = t > 1
            if again.any():
                out["g"].append(g)
                out["h"].append(_blob(x[again]))
                out["hot"].append(_blob(t[again] > hot))
        return pa.table(out, schema=WANTED)

    return body


def gather_occurrences(buckets: int, length: int, gram: int):
    """Pass 2 over a document group: wanted anchors with their windows' bytes, equal ones settled here, by bucket of the hash."""

    def body(key, docs, control):
        g = Group(docs, _copies(control), length)
        h, pos, lo, hi = anchors(g.buf, g.valid, length, gram)
        sent = [x for x in zip(control.column("h").to_pylist(), control.column("hot").to_pylist()) if x[0]]
        if not sent or not len(h):
            return pa.table({f.name: [] for f in FOUND}, schema=FOUND)
        w = np.concatenate([np.frombuffer(x, np.uint64) for x, _ in sent])
        hot = np.concatenate([np.frombuffer(x, bool) for _, x in sent])
        order = np.argsort(w)
        w, hot = w[order], hot[order]
        at = np.minimum(np.searchsorted(w, h), len(w) - 1)
        mine = w[at] == h
        h, pos, lo, hi, is_hot = h[mine], pos[mine], lo[mine], hi[mine], hot[at[mine]]
        near, far = pos - hi, pos - lo
        # a hot anchor becomes one occurrence for each of its windows, anchored at the window's start
        width = np.where(is_hot, hi - lo + 1, 1)
        src = np.repeat(np.arange(len(h)), width)
        step = np.arange(len(src)) - np.repeat(np.cumsum(width) - width, width)
        single = is_hot[src]
        pos = np.where(single, lo[src] + step, pos[src])
        near, far, h = np.where(single, 0, near[src]), np.where(single, 0, far[src]), h[src]
        parts, cuts = [], []

        def settle(h, pos, near, far, data):
            new = firsts(h, near, far, data)
            old = ~new
            cuts.append(np.stack([pos[old] - far[old], pos[old] - near[old]], axis=1))
            return h[new], pos[new], near[new], far[new], data[new]

        for a in range(0, len(h), CHUNK):
            x = slice(a, a + CHUNK)
            data = occurrence_bytes(g.buf, pos[x], near[x], far[x], length, gram)
            hx = h[x].copy()
            if single[x].any():
                hx[single[x]] = _mix(row_hash(data[single[x]]) ^ np.uint64(0x5851F42D4C957F2D))
            parts.append(settle(hx, pos[x], near[x], far[x], data))
            if len(parts) > 1 and sum(len(p[0]) for p in parts[-2:]) < CHUNK:  # small rests are settled together
                parts[-2:] = [settle(*map(np.concatenate, zip(*parts[-2:])))]
        h, pos, near, far, data = settle(*map(np.concatenate, zip(*parts)))
        doc = g.document(pos)
        b = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        first = np.flatnonzero(np.diff(b[order], prepend=-1))
        off = np.stack([near, far], axis=1).astype(np.uint8)
        out = {f.name: [] for f in FOUND}
        cut = np.concatenate(cuts)
        cut_doc = g.document(cut[:, 0]) if len(cut) else np.empty(0, np.int64)
        settled = (_blob(g.row[cut_doc]), _blob(cut - g.begin[cut_doc][:, None])) if len(cut) else (b"", b"")
        carrier = key[0].as_py() * 2654435761 % max(len(first), 1)  # what is settled goes along with one bucket, another for each group
        for k, (x, y) in enumerate(zip(first.tolist(), np.append(first[1:], len(order)).tolist())):
            i = order[x:y]
            for name, v in zip(FOUND.names, (int(b[i[0]]), key[0].as_py(), _blob(h[i]), _blob(g.row[doc[i]]), _blob(pos[i] - g.begin[doc[i]]), _blob(off[i]), _blob(data[i]), *(settled if k == carrier else (b"", b"")))):
                out[name].append(v)
        return pa.table(out, schema=FOUND)

    return body


def sort_occurrences(length: int, gram: int):
    """Per bucket: the starts of windows that occur earlier, as ranges."""
    side = 2 * length - gram

    def body(key, part):
        gs, rows = part.column("g").to_pylist(), part.column("row").to_pylist()
        take = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in part.column(name).to_pylist()])
        h, row, pos = take("h", np.uint64), take("row", np.int64), take("pos", np.int64)
        g = np.repeat(np.array(gs, np.int64), [len(x) // 8 for x in rows])
        off, data = take("off", np.uint8).reshape(-1, 2).astype(np.int64), take("data", np.uint8).reshape(-1, side)
        order = np.lexsort((pos, row, h))
        h, row, pos, g, off, data = h[order], row[order], pos[order], g[order], off[order], data[order]
        near, far = off[:, 0], off[:, 1]
        new = firsts(h, near, far, data)
        out = [(g[~new], row[~new], (pos - far)[~new], (pos - near)[~new])]
        # of what is left, hashes that occur more than once
        h, row, pos, g, near, far, data = h[new], row[new], pos[new], g[new], near[new], far[new], data[new]
        more = np.zeros(len(h), bool)
        same = h[1:] == h[:-1]
        more[1:] |= same
        more[:-1] |= same
        h, row, pos, g, near, far, data = h[more], row[more], pos[more], g[more], near[more], far[more], data[more]
        r, a, b = runs(repeated_windows(h, near, far, data, length, gram))
        out.append((g[r], row[r], pos[r] - b, pos[r] - a))
        cut = take("cut", np.int64).reshape(-1, 2)
        settled = part.column("cut_row").to_pylist()
        out.append((np.repeat(np.array(gs, np.int64), [len(x) // 8 for x in settled]), take("cut_row", np.int64), cut[:, 0], cut[:, 1]))
        g, row, a, b = map(np.concatenate, zip(*out))
        return pa.table({"g": g, "row": row, "a": a, "b": b}, schema=CUTS)

    return body


def cut_documents(length: int):
    """Pass 3 over a document group: removes what the ranges cover."""

    def body(key, docs, control):
        copies = _copies(control)
        rows, a, b = (control.column(c).to_numpy(zero_copy_only=False) for c in ("row", "a", "b"))
        is_cut = ~control.column("copy").to_numpy(zero_copy_only=False).astype(bool)
        rows, a, b = rows[is_cut].astype(np.int64), a[is_cut].astype(np.int64), b[is_cut].astype(np.int64) + length
        order = np.lexsort((a, rows))
        rows, a, b = rows[order], a[order], b[order]
        out = {f.name: [] for f in OUT}
        for row, id_, t in zip(docs.column("row").to_pylist(), docs.column("id").to_pylist(), docs.column("t")):
            raw = t.as_py()
            spans: list[list[int]] = []
            if row in copies:
                spans = [[0, len(raw)]] if len(raw) >= length else []
            else:
                x, y = np.searchsorted(rows, [row, row + 1])
                for p, q in zip(a[x:y].tolist(), b[x:y].tolist()):
                    if spans and p <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], q)
                    else:
                        spans.append([p, q])
            digest, at = hashlib.sha256(), 0
            for p, q in spans:
                digest.update(raw[at:p])
                at = q
            digest.update(raw[at:])
            for name, v in zip(OUT.names, (row, id_, len(raw), sum(q - p for p, q in spans), len(spans), digest.hexdigest())):
                out[name].append(v)
        return pa.table(out, schema=OUT)

    return body


def _ddl(schema: pa.Schema) -> str:
    kinds = {"int64": "long", "binary": "binary", "string": "string"}
    return ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema)


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: row, id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    raw = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    d = numbered(docs, key, {"id": F.col(key).cast("long"), "t": raw})
    rows = materialise(d.select("row", F.octet_length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("sha")), "suffix-rows")
    n_bytes, n_rows = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count(F.lit(1))).first()
    n = partitions(spark)
    groups = max(1, min(n_rows, max(-(-n_bytes // group_bytes), 2 * n)))
    g = F.pmod(F.xxhash64("row"), F.lit(groups))
    # rows whose text an earlier row has
    copies = rows.groupBy("sha").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select("sha", "first")
    copies = materialise(copies, "suffix-firsts")  # a plain table, so that AQE can split a hot text in the join
    copies = materialise(rows.join(copies, "sha").where("row <> first").select("row", g.alias("g")), "suffix-copies")
    none = lambda kind: F.lit(None).cast(kind)
    dealt = d.select("row", "id", g.alias("g"), "t").repartition(n, "g")
    told = copies.select("g", "row", F.lit(True).alias("copy"))
    counted = dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(count_anchors(max(1, n_bytes // COUNT_BYTES, n), length, gram), _ddl(COUNTS))
    wanted = counted.groupBy("bucket").applyInArrow(wanted_anchors(hot), _ddl(WANTED))
    told2 = told.select("g", "row", "copy", none("binary").alias("h"), none("binary").alias("hot")).unionByName(
        wanted.select("g", none("long").alias("row"), F.lit(False).alias("copy"), "h", "hot")
    )
    found = dealt.groupBy("g").cogroup(told2.groupBy("g")).applyInArrow(gather_occurrences(max(1, n_bytes // SORT_BYTES, n), length, gram), _ddl(FOUND))
    cuts = found.groupBy("bucket").applyInArrow(sort_occurrences(length, gram), _ddl(CUTS))
    told3 = told.select("g", "row", "copy", none("long").alias("a"), none("long").alias("b")).unionByName(cuts.select("g", "row", F.lit(False).alias("copy"), "a", "b"))
    return dealt.groupBy("g").cogroup(told3.groupBy("g")).applyInArrow(cut_documents(length), _ddl(OUT))


@register("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("row").withColumnRenamed("id", "doc_id")
