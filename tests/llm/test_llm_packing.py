import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import edge_docs, edge_rows, empty_docs, prose, unique_docs
from tokenizers import Tokenizer

from starlens.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.token_path())


def brute(tokenizer, text, length=1024):
    ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
    n = len(ids)
    first = n % length or length
    cuts = [0, *range(min(first, n), n, length), n]
    return [(i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def check(rows, got, tokenizer, length=1024):
    exp = Counter((k, *p) for k, t in rows for p in brute(tokenizer, t, length))
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == exp
    seq = defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.length))
    for places in seq.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= length
    return len(seq)


def test_edge_rows(spark, tokenizer):
    check([(r[0], r[1]) for r in edge_rows()], P.pack_documents(edge_docs(spark)).collect(), tokenizer)


def test_few_sequences_over_several_shards(spark, tokenizer):
    texts = [prose(20 + 7 * i % 300, i) for i in range(400)]
    got = P.pack_documents(unique_docs(spark, texts), shard=60, length=256).collect()
    n = check(list(enumerate(texts)), got, tokenizer, 256)
    assert n <= 1.02 * sum(r.length for r in got) / 256 + 2


@pytest.mark.parametrize("text", ["a  b", " lead", "trail ", "x\n\ny", "a\n b", "it's <|endoftext|> here", "tab\tx", " a  b", "a  b", "\x00 nul \x00", "naïve café 12 345", "a\rb", "\x1c\x1d x\x1cy", "1 2\n3 a.b, (c)!", "don't can't. it's, x''s", "end.\n", "\nstart", "ſ ǆ Ω я 漢字. a漢", "a.'s b'll!", "word### x$$$ \"q\"", "²³ ½ ٣", "é̀ combining", "<|endoftext|>"])
def test_cached_units_encode_as_the_whole_text(text, tokenizer):
    enc = P.encoder(P.token_path())
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_cache_turns_over(tokenizer, monkeypatch):
    monkeypatch.setattr(P, "CACHE_WORDS", 10)
    enc = P.Encoder(P.token_path())
    for i in range(20):
        t = prose(30, i)
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert all(len(w) <= 10 and len(w.old) <= 10 for w in (enc.first, enc.after))


def test_local_search_beats_best_fit():
    r = np.random.default_rng(1)
    for low, high, n in ((300, 700, 2000), (1, 1023, 3000), (200, 400, 1500)):
        sizes = r.integers(low, high, n)
        bins = P.pack(sizes, 1024)
        assert sorted(x for b in bins for x in b) == list(range(n))
        assert all(sizes[b].sum() <= 1024 for b in bins)
        assert len(bins) <= len(P.best_fit(sizes, 1024).items)
    assert len(P.pack(np.array([600, 600, 424, 424, 512, 512]), 1024)) == 3


def test_no_step_is_left():
    cap = 40
    r = np.random.default_rng(2)
    for low, high, n in ((5, 25, 60), (1, 39, 80), (8, 16, 70), (12, 19, 60), (3, 9, 60)):
        sizes = r.integers(low, high, n)
        bins = P.pack(sizes, cap)
        assert sorted(x for b in bins for x in b) == list(range(n)) and all(sizes[b].sum() <= cap for b in bins)
        held = [[int(sizes[x]) for x in b] for b in bins if sizes[b].sum() < cap]

        def better(change):
            new = {i: sum(held[i]) + v for i, v in change.items()}
            return max(new.values()) <= cap and (cap in new.values() or sum(v * v for v in new.values()) > sum(sum(held[i]) ** 2 for i in new))

        def add(*pairs):
            out = {}
            for i, v in pairs:
                out[i] = out.get(i, 0) + v
            return out

        for i, mine in enumerate(held):
            rest = [(j, v) for j, other in enumerate(held) if j != i for v in other]
            for a, (j, x) in enumerate(rest):
                assert not better(add((i, x), (j, -x)))
                for p in mine:
                    assert x <= p or not better(add((i, x - p), (j, p - x)))
                    for c, (k, y) in enumerate(rest):
                        assert a == c or x + y <= p or not better(add((i, x + y - p), (j, -x), (k, p - y))), (low, high)


def test_empty_table(spark):
    assert P.pack_documents(empty_docs(spark)).collect() == []


def test_index_in_place_equals_a_new_one():
    r = np.random.default_rng(4)
    sizes = r.integers(3, 30, 200)
    bins = P.best_fit(sizes, 64)
    open_ = {b for b in range(len(bins.fill)) if 0 < bins.fill[b] < 64}
    index = P.Others(bins.items, bins.fill, sizes, 64, open_)
    for h in sorted(open_)[::3]:
        index.drop(h)
        new = P.Others(bins.items, bins.fill, sizes, 64, open_ - {h})
        assert index.keys.tolist() == new.keys.tolist() and index.sums.tolist() == new.sums.tolist()
        assert index.starts.tolist() == new.starts.tolist() and index.emptiest().tolist() == new.emptiest().tolist()
        index.put(h)
    new = P.Others(bins.items, bins.fill, sizes, 64, open_)
    assert sorted(zip(index.keys, index.pieces)) == sorted(zip(new.keys, new.pieces))
    assert sorted(zip(index.sums, index.firsts, index.seconds)) == sorted(zip(new.sums, new.firsts, new.seconds))


def test_search_ends_at_the_bound_and_beats_best_fit_on_middle_lengths():
    r = np.random.default_rng(1)
    sizes = r.integers(200, 400, 1500)
    assert len(P.pack(sizes, 1024)) < 0.98 * len(P.best_fit(sizes, 1024).items)
    sizes = r.integers(1, 20, 3000)
    assert len(P.pack(sizes, 1024, to_bound=True)) == -(-int(sizes.sum()) // 1024)
