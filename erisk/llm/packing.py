"""Best-fit packing: documents in sequences of at most 4096 tokens, by the sum-of-squares rule.

A document's tokens end with an end id; only longer ones are cut, into full pieces and a rest. Pieces meet in blocks
dealt by a hash, some 32,000 pieces each, so no task grows with the corpus, repeated rows or not. In a block, longest first,
each piece goes where the squared counts of open bins per residual gap add up to the least afterwards, among the bins it fits
into; a new one is opened only where it fits none. Gaps are numbers up to 4096, so a step is one vector operation over counts. Open bins left at the end of a block
cost about 0.2 % over the lower bound (README).

Tokens never leave their task: pieces travel as lengths, places and a checksum. White space ends every token of this
tokenizer, so a text's ids are its words' ids joined; a worker remembers the words it has met (tested against whole texts).

Defined results: null and empty texts are one piece, the end id; repeated rows are packed each on its own; an empty table
gives no rows. Only doc_id and text are read.
"""
from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erisk.llm.common import tokenizer, written

CAPACITY, END_ID, BLOCK_PIECES = 4096, 1, 32_768
#: Words remembered by a worker, about 80 MB; beyond that it starts anew. Longer words are not remembered.
REMEMBERED, LONGEST = 500_000, 60
#: Separators that Python splits at and the tokenizer does not: such a text is encoded as a whole.
ODD_SPACES = re.compile("[\x1c-\x1f]")
#: Letters whose lower case and composed form every Unicode version gives alike.
LATIN = re.compile("[\x01-\u012f\u0131-\u024f]+")
#: Fixed values of the tokenizer: how it cuts a word, and the printable bytes of its byte alphabet.
CUTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
END = "</w>"
PIECE = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def ranked(path: str):
    """The file's merges as ranks of byte strings, a zero byte for the word's end, if its numbers are in order of merging:
    then tiktoken, which is faster, gives the same ids (tested). None for a file of another kind."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if model.get("end_of_word_suffix") != END or any(vocabulary.get(a + b) != 512 + k for k, (a, b) in enumerate(merges)):
        return None
    others = [b for b in range(256) if b not in PRINTABLE]
    byte = {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(others)}
    ranks = {}
    for token, k in vocabulary.items():
        body = token.removesuffix(END)
        if all(c in byte for c in body):
            ranks[bytes(byte[c] for c in body) + b"\0" * (body != token)] = k
    return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})


class Words(dict):
    """Word -> its ids as little-endian unsigned 32-bit numbers; encoded when first met."""

    def __init__(self, path: str):
        super().__init__()
        self.whole, self.fast = tokenizer(path), ranked(path)

    def __missing__(self, word: str) -> bytes:
        if self.fast and LATIN.fullmatch(word):
            ids = self.fast.encode_ordinary("\0".join(CUTS.findall(word.lower())) + "\0")
        else:
            ids = self.whole.encode(word, add_special_tokens=False).ids
        out = array("I", ids).tobytes()
        if len(word) <= LONGEST:
            self[word] = out
        return out


@functools.lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


def encoded(texts: list[str | None], path: str) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers, by the tokenizer's file."""
    known = words_of(path)
    for text in texts:
        if text and ODD_SPACES.search(text):
            yield array("I", known.whole.encode(text, add_special_tokens=False).ids).tobytes()
            continue
        if len(known) > REMEMBERED:
            known.clear()
        yield b"".join(map(known.__getitem__, text.split())) if text else b""


def pieces(text: Column, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> Column:
    """Array of the pieces of each text: number, start, length and crc32 of the ids."""
    @F.arrow_udf("array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint>>")
    def cut(texts: pa.Array) -> pa.Array:
        end, size = np.array([end_id], "<u4").tobytes(), 4 * capacity
        out = []
        for ids in encoded(texts.to_pylist(), path):
            ids += end
            out.append([{"piece": k, "start": k * capacity, "length": len(p) // 4, "ids_crc32": zlib.crc32(p)}
                        for k, p in enumerate(ids[a:a + size] for a in range(0, len(ids), size))])
        return pa.array(out, pa.list_(PIECE))
    return cut(text)


NO_BIN = np.iinfo(np.int64).max


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the given order."""
    count = np.zeros(capacity + 1, np.int64)                  # open bins by gap
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        change = 2 * (count[:capacity - n] - count[n:capacity]) + 2      # a bin of gap g >= n becomes one of gap g - n
        if n < capacity:
            change[0] = 1 - 2 * count[n]                                 # or is full
            change[count[n:capacity] == 0] = NO_BIN
        best = int(change.argmin()) if n < capacity else 0
        if n == capacity or change[best] == NO_BIN:                      # a new bin only where none fits
            gap, b = capacity, len(fill)
            fill.append(0)
        else:
            gap = n + best
            b = bins[gap].pop()
            count[gap] -= 1
        where[i], offset[i] = b, fill[b]
        fill[b] += n
        if gap > n:
            count[gap - n] += 1
            bins[gap - n].append(b)
    return where, offset


OUT = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack_block(capacity: int):
    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        where, offset = sum_of_squares(b["length"].to_numpy(), capacity)
        return b.assign(sequence_id=b["block"].to_numpy(np.int64) * (1 << 32) + where, offset=offset).drop(columns="block")
    return run


def packed(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    cut = written(own.select("doc_id", F.explode(pieces(F.col("text"), path, capacity, end_id)).alias("p")).select("doc_id", "p.*"), "pieces")
    blocks = -(-max(1, cut.count()) // block_pieces)
    # the place in the written table spreads rows that are equal in all else
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(pack_block(capacity), OUT)
