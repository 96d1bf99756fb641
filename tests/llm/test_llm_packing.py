"""Pieces against whole-text encoding, packing invariants and density."""
import bisect
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from erisk.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_encode_like_whole_texts(hard_texts):
    texts = [t for t in hard_texts if t] + ["It's café NBSP em, \x1cfs\x85nel <|endoftext|> é ΑΣ ΣΑΣ x\r\ny\tz  '' 's 12a", " lead", "İ ǅ ﬁ"]
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    for t, got in zip(texts, packing.encoded(texts, PATH), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_many_words_encode_alike(spark):
    """All words of a table, and random Latin ones, by the remembered way and by the tokenizer."""
    rng = np.random.default_rng(8)
    letters = [chr(c) for c in [*range(33, 127), *range(0xA1, 0x250)] if not chr(c).isspace()]
    words = {"".join(rng.choice(letters, rng.integers(1, 14))) for _ in range(20_000)}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        words |= set((r["text"] or "").split())
    words = sorted(words)
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    assert packing.ranked(PATH) is not None
    for w, got, want in zip(words, packing.encoded(words, PATH), tok.encode_batch(words, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, w


def test_packed(documents, prose, hard_texts):
    rows = [(k, prose(k, 3 + 37 * k % 900)) for k in range(150)] + [(1000 + k, t) for k, t in enumerate(hard_texts)] + [(None, "null id"), (3, prose(3, 114))]
    got = [r.asDict() for r in packing.packed(documents(rows), PATH, block_pieces=64).collect()]
    tok = Tokenizer.from_file(PATH)
    want = []
    for k, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(k, p, p * 4096, len(x), zlib.crc32(x.tobytes())) for p, x in enumerate(ids[a:a + 4096] for a in range(0, len(ids), 4096))]
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(key, want)) == sorted(key((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    assert packing.packed(documents([]), PATH).count() == 0


def test_density():
    rng = np.random.default_rng(0)
    n = np.sort(np.clip(rng.lognormal(6, 1, 8000).astype(int), 1, 4096))[::-1]
    where, _ = packing.sum_of_squares(n, 4096)
    assert where.max() + 1 <= 1.01 * -(-n.sum() // 4096) + 1


@pytest.mark.parametrize("low, high", [(1, 4096), (500, 3000), (1300, 2800)])
def test_close_to_best_fit_decreasing(low, high):
    n = np.sort(np.random.default_rng(1).integers(low, high, 5000))[::-1]
    gaps, bins = [], 0
    for x in n.tolist():
        k = bisect.bisect_left(gaps, x)
        bins += k == len(gaps)
        gap = gaps.pop(k) if k < len(gaps) else 4096
        bisect.insort(gaps, gap - x)
    assert packing.sum_of_squares(n, 4096)[0].max() + 1 <= 1.01 * bins


def test_equal_rows_are_dealt_round(documents):
    got = packing.packed(documents([(7, "the same text")] * 700), PATH, block_pieces=64).collect()
    per_block = np.bincount([r["sequence_id"] >> 32 for r in got])
    assert len(got) == 700 and len(per_block) == 11 and per_block.max() < 128


def test_rule_picks_the_least_sum_of_squares():
    """Each step against trying every open gap."""
    rng = np.random.default_rng(4)
    sizes, capacity, bins = rng.integers(1, 13, 200), 12, []
    where, offset = packing.sum_of_squares(sizes, capacity)
    for n, b, at in zip(sizes.tolist(), where.tolist(), offset.tolist(), strict=True):
        def squares(fills):
            gaps = [capacity - f for f in fills if f < capacity]
            return sum(gaps.count(g) ** 2 for g in set(gaps))
        tries = [squares([f + n if k == i else f for k, f in enumerate(bins)]) for i, f0 in enumerate(bins) if f0 + n <= capacity] or [squares([*bins, n])]
        assert (b == len(bins)) == all(f + n > capacity for f in bins)
        if b == len(bins):
            bins.append(0)
        assert bins[b] == at
        bins[b] += n
        assert bins[b] <= capacity and squares(bins) == min(tries)
