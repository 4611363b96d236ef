"""Best-fit packing of tokenised documents into fixed-length sequences, improved by swap-based local search.

Documents are tokenised in place (tokens never move); a longer document is cut into full sequences and one shorter first piece.
Pieces below full length are dealt into shards by a hash of the id, some thousands of pieces each, and packed per
shard: best fit by falling length, then local search between underfull bins.  A step exchanges one piece for one, two for one, or moves a
piece, whenever that raises the sum of squared fills; full bins are settled, and bins that lose their last piece
disappear.  What stays underfull in each shard meets that of other shards in a second round of smaller groups, and what is not nearly full then in a
third; both end their search early where fewer bins can't hold their pieces.

Only (id, length, checksums) is shuffled.  A shard's size does not depend on sources or copies, so no key is hot.

Defined cases: null text counts as empty: one piece, the end mark alone; a text of any length is encoded whole; repeated
rows are packed each on its own; pieces of equal length are taken in the order of their rows; an empty table gives an empty result; columns
other than those named are not read, so their names can't clash.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.base import materialise, partitions
from starlens.llm.registry import register, table

SEQUENCE = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
SHARD = 16_000  # pieces packed together
PASSES = 4  # quick sweeps of the local search, before those that go on until nothing changes
CACHE_WORDS = 250_000  # words in each of the two generations of a worker's cache
TAIL = "#$%&()*+,-./:;<=>?@[]^_`{|}~!\""  # ASCII marks that end a word (no apostrophe: contractions are split differently)


class OddSpace(Exception):
    """White space that is not one space or newline between two words."""


class Words(dict):
    """Ids of words after ``lead`` (a space, or nothing at the start of a line); two generations bound it."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead, self.old = encoder, lead, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            core = word.rstrip(TAIL)
            if core.isalpha() and core < "\u0250" and max(core) < "\u0250":  # letters, then marks: two pieces of the tokenizer's pattern
                ids = self.encoder.piece(self.lead + word) if len(core) == len(word) else self[core] + self.encoder.marks(word[len(core) :])
            elif word.split() != [word]:
                raise OddSpace
            else:
                ids = self.encoder.whole(self.lead + word)
        self[word] = ids
        return ids


class Encoder:
    """Text to little-endian 32-bit ids by the public tokenizer, with a cache over words.

    The byte-level BPE's pattern splits before a single space, and makes a newline between two words a piece of its own, so a
    word and the space before it encode alone as they do within the text.  Texts with other white space or with special
    tokens are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
        self.first, self.after = Words(self, ""), Words(self, " ")
        self.marks = functools.lru_cache(20_000)(self.piece)
        self.newline = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of a text that the pattern does not split."""
        letters = text.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.special):
            return self.whole(text)
        first, after, out = self.first, self.after, []
        try:
            for line in text.split("\n"):
                words = line.split(" ")
                out.append(first[words[0]] + b"".join([after[w] for w in words[1:]]))
        except OddSpace:
            return self.whole(text)
        return self.newline.join(out)


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def token_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pieces_of(ids: bytes, length: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces: the first may be shorter, the others are full."""
    n = len(ids) // 4
    first = n % length or min(n, length)
    cuts = [0, *range(first, n, length), n]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(cuts, cuts[1:])]


def tokenised(docs: DataFrame, key: str, text: str, vocabulary: str, length: int, end_id: int) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, crcs (of its pieces, in order)."""
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("crcs", pa.list_(pa.int64()))])

    def body(batches):
        enc = encoder(token_path(vocabulary))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = enc.encode(t or "") + end
                    out.append({"id": k, "n_tokens": len(ids) // 4, "crcs": [c for _, _, c in pieces_of(ids, length)]})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(body, "id long, n_tokens long, crcs array<long>")


class Bins:
    """Open bins of one shard: fills and piece lists; ``by_fill`` finds a bin of a given fill at once."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[int]] = []  # pieces of a bin
        self.fill: list[int] = []

    def add(self, piece: int, size: int, b: int | None = None) -> int:
        if b is None:
            self.items.append([])
            self.fill.append(0)
            b = len(self.fill) - 1
        self.items[b].append(piece)
        self.fill[b] += size
        return b


def best_fit(sizes: np.ndarray, capacity: int) -> Bins:
    """Best fit by falling length; bins are kept by room left, and a bit mask names the rooms that occur."""
    bins, rooms, mask = Bins(capacity), [[] for _ in range(capacity + 1)], 0
    for piece in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[piece])
        wide = mask >> size
        if wide:
            room = size + (wide & -wide).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
            bins.add(piece, size, b)
        else:
            b = bins.add(piece, size)
        left = capacity - bins.fill[b]
        rooms[left].append(b)
        mask |= 1 << left
    return bins


def local_search(bins: Bins, lengths: np.ndarray, passes: int = PASSES, enough: int = 0) -> list[list[int]]:
    """Raises the sum of squared fills until no step does: quick sweeps first, then ``settle``.  It stops at ``enough`` bins."""
    if len(bins.items) > enough:
        quick_sweeps(bins, lengths, passes)
        settle(bins, lengths, enough)
    return [x for x in bins.items if x]


def quick_sweeps(bins: Bins, lengths: np.ndarray, passes: int) -> None:
    """At most ``passes`` sweeps that look at the likeliest partners only.

    Taking ``x`` tokens into a bin of fill f from one of fill g <= f adds 2x(f - g + x) to the sum, so every step that
    fills a fuller bin further is a gain.  A sweep runs from the fullest open bin down; partners are pieces of emptier bins.
    """
    cap, items, fill, sizes = bins.capacity, bins.items, bins.fill, lengths.tolist()
    for _ in range(passes):
        order = sorted((b for b in range(len(fill)) if 0 < fill[b] < cap), key=lambda b: (-fill[b], b))
        place = {b: k for k, b in enumerate(order)}
        home = {p: b for b in order for p in items[b]}
        by_size: list[list[int]] = [[] for _ in range(cap + 1)]  # pieces of open bins, of the emptiest last
        for b in order:
            for p in items[b]:
                by_size[sizes[p]].append(p)
        present = sum(1 << s for s, at in enumerate(by_size) if at)
        changed = False

        def partners(size: int, after: int, most: int = 2) -> list[int]:
            """Up to ``most`` pieces of this size in bins that are open and come after place ``after``."""
            found = []
            for p in reversed(by_size[size]):
                if place[home[p]] <= after:
                    break
                if 0 < fill[home[p]] < cap:
                    found.append(p)
                    if len(found) == most:
                        break
            return found

        def move(b: int, k: int, room: int) -> list[tuple[int, int]]:
            fits = present & ((1 << (room + 1)) - 1)
            while fits:
                s = fits.bit_length() - 1
                for p in partners(s, k, 1):
                    return [(p, b)]
                fits &= ~(1 << s)
            return []

        def exchange(b: int, k: int, room: int) -> list[tuple[int, int]]:
            for p in sorted(items[b], key=lambda p: sizes[p]):
                s = sizes[p]
                wide = present & ((1 << (min(cap, s + room) + 1)) - 1) & ~((1 << (s + 1)) - 1)
                while wide:
                    t = wide.bit_length() - 1
                    for q in partners(t, k, 1):
                        return [(q, b), (p, home[q])]
                    wide &= ~(1 << t)
            return []

        def two_for_one(b: int, k: int, room: int) -> list[tuple[int, int]]:
            for p in items[b]:
                want = sizes[p] + room  # two pieces that fill the bin in its place
                for t in range(want // 2, 0, -1):
                    if not (present >> t & 1 and present >> (want - t) & 1):
                        continue
                    for x in partners(t, k):
                        for y in partners(want - t, k):
                            if x != y and fill[home[y]] - sizes[y] + sizes[p] <= cap:
                                return [(x, b), (y, b), (p, home[y])]
            return []

        for k, b in enumerate(order):
            while 0 < fill[b] < cap:
                room = cap - fill[b]
                step = move(b, k, room) or exchange(b, k, room) or two_for_one(b, k, room)
                if not step:
                    break
                for p, to in step:
                    items[home[p]].remove(p)
                    fill[home[p]] -= sizes[p]
                    items[to].append(p)
                    fill[to] += sizes[p]
                for p, to in step:
                    by_size[sizes[p]].remove(p)
                    home[p] = to
                    at = by_size[sizes[p]]
                    i = len(at)
                    while i and place[home[at[i - 1]]] > place[to]:
                        i -= 1
                    at.insert(i, p)
                changed = True
        if not changed:
            break


def settle(bins: Bins, lengths: np.ndarray, enough: int = 0) -> None:
    """Steps between all open bins until none fills a bin or raises the sum of squared fills.  It ends, as every step raises
    (full bins, sum of squares) and full bins stay; or once there are no more than ``enough`` bins."""
    cap, items, fill = bins.capacity, bins.items, bins.fill
    open_ = {b for b in range(len(fill)) if 0 < fill[b] < cap}
    left = sum(f > 0 for f in fill)
    others = Others(items, fill, lengths, cap, open_)
    changed = True
    while changed and left > enough:
        changed = False
        for b in sorted(open_, key=lambda b: (-fill[b], b)):
            if b not in open_:
                continue
            others.drop(b)
            while b in open_ and left > enough:
                step = _step(b, items, fill, lengths, cap, others)
                if not step:
                    break
                touched = {x for _, source, to in step for x in (source, to)}
                for h in touched - {b}:
                    others.drop(h)
                for p, source, to in step:
                    items[source].remove(p)
                    fill[source] -= int(lengths[p])
                    items[to].append(p)
                    fill[to] += int(lengths[p])
                gone = {x for x in touched if not 0 < fill[x] < cap}
                left -= sum(fill[x] == 0 for x in gone)
                open_ -= gone
                for h in touched - {b} - gone:
                    others.put(h)
                changed = True
            if b in open_:
                others.put(b)


FILL, HOME = 42, 28  # a key is size, fill and bin in one number: its size begins at bit FILL, its fill at bit HOME


class Others:
    """The pieces of the open bins but those taken out, sorted by size, fill of their bin and bin; the sums of two pieces of one bin likewise.

    A step changes two or three bins, so their entries are taken out and put back in place; nothing is sorted anew.
    """

    def __init__(self, items: list[list[int]], fill: list[int], lengths: np.ndarray, cap: int, open_: set[int]):
        self.items, self.fill, self.lengths, self.cap = items, fill, lengths, cap
        none = np.zeros(0, np.int64)
        found = [self._entries(h) for h in sorted(open_)]
        singles, pieces, sums, firsts, seconds = (np.concatenate([none, *x]) for x in (zip(*found) if found else [()] * 5))
        order = np.argsort(singles, kind="stable")
        self.keys, self.pieces = singles[order], pieces[order]
        order = np.argsort(sums, kind="stable")
        self.sums, self.firsts, self.seconds = sums[order], firsts[order], seconds[order]
        self._view()

    def _entries(self, h: int) -> tuple[np.ndarray, ...]:
        """Keys and pieces of a bin, and keys and pieces of its pairs."""
        p = np.array(self.items[h], np.int64)
        size = self.lengths[p].astype(np.int64)
        order = np.argsort(size, kind="stable")
        p, size = p[order], size[order]
        low = (self.fill[h] << HOME) | h
        i, j = np.triu_indices(len(p), 1)
        total = size[i] + size[j]
        order = np.argsort(total, kind="stable")
        return (size << FILL) | low, p, (total[order] << FILL) | low, p[i][order], p[j][order]

    @staticmethod
    def _runs(keys: np.ndarray, mine: np.ndarray) -> np.ndarray:
        mine = np.unique(mine)
        return np.concatenate([np.arange(a, b) for a, b in zip(np.searchsorted(keys, mine), np.searchsorted(keys, mine, "right"))] or [np.zeros(0, np.int64)])

    def drop(self, h: int) -> None:
        singles, _, sums, _, _ = self._entries(h)
        at = self._runs(self.keys, singles)
        self.keys, self.pieces = np.delete(self.keys, at), np.delete(self.pieces, at)
        if len(sums):
            at = self._runs(self.sums, sums)
            self.sums, self.firsts, self.seconds = np.delete(self.sums, at), np.delete(self.firsts, at), np.delete(self.seconds, at)
        self._view()

    def put(self, h: int) -> None:
        singles, pieces, sums, firsts, seconds = self._entries(h)
        at = np.searchsorted(self.keys, singles)
        self.keys, self.pieces = np.insert(self.keys, at, singles), np.insert(self.pieces, at, pieces)
        if len(sums):
            at = np.searchsorted(self.sums, sums)
            self.sums, self.firsts, self.seconds = np.insert(self.sums, at, sums), np.insert(self.firsts, at, firsts), np.insert(self.seconds, at, seconds)
        self._view()

    def _view(self) -> None:
        self._starts = self._emptiest = None

    def home(self, at: int) -> int:
        return int(self.keys[at]) & ((1 << HOME) - 1)

    def fill_at(self, at) -> np.ndarray:
        return (self.keys[at] >> HOME) & ((1 << FILL - HOME) - 1)

    @property
    def starts(self) -> np.ndarray:
        """Place of the first piece of each size."""
        if self._starts is None:
            self._starts = np.searchsorted(self.keys, np.arange(self.cap + 2, dtype=np.int64) << FILL)
        return self._starts

    def least(self) -> int:
        return int(self.keys[0]) >> FILL

    def emptiest(self) -> np.ndarray:
        """Fill of the emptiest bin that holds a piece of each size; a large number where there is none."""
        if self._emptiest is None:
            at = np.minimum(self.starts[:-1], len(self.keys) - 1)
            self._emptiest = np.where(self.starts[:-1] < self.starts[1:], self.fill_at(at), 1 << 40)
        return self._emptiest

    def fullest(self, piece: int) -> np.ndarray:
        """Place of the piece of each size in the fullest bin that takes one of size ``piece`` for it; -1 where there is none."""
        size = np.arange(self.cap + 1, dtype=np.int64)
        most = np.clip(self.cap - piece + size, 0, self.cap)
        at = np.searchsorted(self.keys, (size << FILL) | (most << HOME) | ((1 << HOME) - 1), "right") - 1
        return np.where((at >= self.starts[:-1]) & (self.cap - piece + size >= 0), at, -1)

    def take(self, size: int) -> tuple[int, int]:
        at = self.starts[size]
        return int(self.pieces[at]), self.home(at)

    def pair(self, total: int) -> tuple[int, int, int, int] | None:
        """(fill, bin, piece, piece) of the emptiest bin with two pieces of this sum."""
        at = int(np.searchsorted(self.sums, total << FILL))
        if at == len(self.sums) or int(self.sums[at]) >> FILL != total:
            return None
        key = int(self.sums[at])
        return key >> HOME & ((1 << FILL - HOME) - 1), key & ((1 << HOME) - 1), int(self.firsts[at]), int(self.seconds[at])


def _step(b: int, items: list[list[int]], fill: list[int], lengths: np.ndarray, cap: int, others: Others) -> list[tuple[int, int, int]]:
    """(piece, from, to) of one step for bin ``b``: a move, one for one, or two for one; empty if there is none."""
    if not len(others.keys):
        return []
    f, room = fill[b], cap - fill[b]
    emptiest, size = others.emptiest(), np.arange(cap + 1)
    good = np.flatnonzero(emptiest[: room + 1] < f + size[: room + 1])
    if len(good):
        q, h = others.take(int(good[-1]))
        return [(q, h, b)]
    mine = sorted({int(lengths[p]): p for p in items[b]}.items())
    for s, p in mine:
        high = min(cap, s + room)
        good = np.flatnonzero(emptiest[s + 1 : high + 1] < f + size[1 : high + 1 - s])
        if len(good):
            q, h = others.take(int(good[-1]) + s + 1)
            return [(q, h, b), (p, b, h)]
    least = 2 * others.least()
    leave = np.where(emptiest < cap, size * size - 2 * emptiest * size, -(1 << 50))  # change of the squares where x leaves
    for s, p in mine:
        if s + room < least:
            continue
        at = others.fullest(s)
        gy = np.where(size > s, np.minimum(emptiest, cap), np.where(at >= 0, others.fill_at(at), 0))
        turn = np.where(at >= 0, 2 * gy * (s - size) + (s - size) ** 2, -(1 << 50))  # where p takes the place of y
        for want in range(s + room, max(s, least - 1), -1):
            d = want - s
            gain = 2 * f * d + d * d
            two = others.pair(want)
            if two and (d == room or two[0] < f + d):
                _, h, x, y = two
                return [(x, h, b), (y, h, b), (p, b, h)]
            total = leave[1:want] + turn[want - 1 : 0 : -1] + gain
            for t in np.flatnonzero(total > (-(1 << 45) if d == room else 0)).tolist():
                found = _apart(others, 1 + t, want - 1 - t, s, f, d, cap)
                if found:
                    (x, hx), (y, hy) = found
                    return [(x, hx, b), (y, hy, b), (p, b, hy)]
    return []


def _apart(others: Others, x: int, y: int, s: int, f: int, d: int, cap: int) -> tuple | None:
    """Pieces of sizes x and y in two bins, of which y's takes a piece of size s for it, with a gain (or a full bin)."""
    xs, ys = range(others.starts[x], others.starts[x + 1]), range(others.starts[y], others.starts[y + 1])
    ys = ys if y > s else reversed(ys)  # those with the largest gain first
    for j in ys:
        gy = int(others.fill_at(j))
        if gy - y + s > cap:
            continue
        for i in xs:
            if others.home(i) != others.home(j):
                gx = int(others.fill_at(i))
                if f + d == cap or 2 * f * d + d * d + x * x - 2 * gx * x + 2 * gy * (s - y) + (s - y) ** 2 > 0:
                    return (int(others.pieces[i]), others.home(i)), (int(others.pieces[j]), others.home(j))
                break  # the emptiest one of another bin; fuller ones gain less
    return None


def pack(sizes: np.ndarray, capacity: int, to_bound: bool = False) -> list[list[int]]:
    """Bins (lists of positions in ``sizes``) of at most ``capacity``; ``to_bound`` ends the search once fewer bins can't hold the pieces."""
    enough = -(-int(sizes.sum()) // capacity) if to_bound else 0
    return local_search(best_fit(sizes, capacity), sizes, enough=enough) if len(sizes) else []


def _packed(rows: DataFrame, group: str, capacity: int, settled: int) -> DataFrame:
    """Packs each group's pieces: (unit, size) rows gain bin and offset; bin is null where the bin holds less than ``settled`` and is passed on."""
    schema = "unit long, size int, shard long, bin long, offset int"

    def body(key, part):
        order = np.lexsort((part.column("unit").to_numpy(),))
        units, sizes = part.column("unit").to_numpy()[order], part.column("size").to_numpy()[order]
        out: dict[str, list] = {"unit": [], "size": [], "shard": [], "bin": [], "offset": []}
        for b, members in enumerate(pack(sizes, capacity, to_bound=settled < capacity)):
            at = 0
            open_ = int(sizes[members].sum()) < settled
            for m in sorted(members):
                out["unit"].append(int(units[m]))
                out["size"].append(int(sizes[m]))
                out["shard"].append(key[0].as_py())
                out["bin"].append(None if open_ else b)
                out["offset"].append(at)
                at += int(sizes[m])
        return pa.table(out, schema=pa.schema([("unit", pa.int64()), ("size", pa.int32()), ("shard", pa.int64()), ("bin", pa.int64()), ("offset", pa.int32())]))

    return rows.groupBy(group).applyInArrow(body, schema)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, length: int = SEQUENCE, end_id: int = END_ID, shard: int = SHARD) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    t = materialise(tokenised(docs, key, text, vocabulary, length, end_id).withColumn("unit", F.monotonically_increasing_id()), "pack-tokens")
    first = F.when(F.col("n_tokens") % length == 0, length).otherwise(F.col("n_tokens") % length).cast("int")
    short = t.where(F.col("n_tokens") % length != 0).select("unit", first.alias("size"))
    n = short.count()
    placed = None
    left = short
    # full bins are settled in the first round, nearly full ones in the second, where groups are smaller, and all in the third
    for k, (size, settled) in enumerate(((shard, length), (max(1, shard // 4), length - length // 16), (max(1, shard // 4), 0))):
        groups = max(1, round((n if not k else left.count()) / size))
        dealt = left.select("unit", "size", F.pmod(F.xxhash64("unit", F.lit(k)), F.lit(groups)).alias("group")).repartition(partitions(t.sparkSession, min(groups, 4096)), "group")
        done = materialise(_packed(dealt, "group", length, settled), "pack-round")
        # a sequence of short pieces is numbered by round, group and bin; a full piece, below zero, by its row of the result
        named = done.where("bin is not null").select("unit", "offset", F.shiftleft("shard", 24).bitwiseOR(F.col("bin")).bitwiseOR(F.lit(k << 60)).alias("seq"))
        placed = named if placed is None else placed.unionByName(named)
        left = done.where("bin is null").select("unit", "size")
    e = t.join(placed, "unit", "left").select("id", "seq", "offset", first.alias("first"), F.posexplode("crcs").alias("piece", "ids_crc32"))
    short_one = (F.col("piece") == 0) & F.col("seq").isNotNull()
    return e.select(
        "id",
        "piece",
        F.when(F.col("piece") == 0, 0).otherwise(F.col("first") + (F.col("piece") - 1).cast("long") * length).cast("long").alias("start"),
        F.when(F.col("piece") == 0, F.col("first")).otherwise(length).cast("long").alias("length"),
        "ids_crc32",
        F.when(short_one, F.col("seq")).otherwise(-F.monotonically_increasing_id() - 1).alias("sequence_id"),
        F.when(short_one, F.col("offset")).otherwise(0).cast("long").alias("offset"),
    )


@register("op9_pack_sequences")
def op9_pack_sequences(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
