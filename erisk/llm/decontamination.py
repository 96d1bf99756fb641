"""Benchmark decontamination by training suffix arrays.

Each Arrow batch of documents is one shard: its words become numbers, the suffixes of the shard are sorted by prefix
doubling, and every test suffix is found by binary search, one word of depth at a time for all suffixes together. That
gives where each window of a benchmark item occurs; its words are hit, and documents with hits are contaminated. Equal
windows are one, with the set of their items, so a place of a document is found at most once for each length of a window,
however often the benchmark or a text repeats itself. The longest verbatim match from a hit place on is found in the sorted
suffixes of the benchmark, by binary search with hashes of runs for comparisons.

A word is `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z become a-z. A window is `window` consecutive words of an item; an
item of fewer words, but at least one, is one window. Documents are neither shuffled nor cut. The benchmark is searched
in blocks of a proven size (`block_bytes`), each sent to the executors once; every block meets every document, and their
spans are merged. A document's row carries its whole verdict, so a lost executor only repeats its own batches.

Defined results: null or empty texts have no words and no hits; an item without words has no window; several rows with
one item_id are one item for counting; an item with a null id marks words but is not named. Repeated documents get equal
verdicts. An empty benchmark hits nothing. Only the id and text columns are read.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")     # in lower-cased UTF-8
WINDOW, BLOCK_BYTES = 10, 4_000_000
DDL = "struct<n_words: bigint, spans: array<struct<start: int, end: int>>, items: array<bigint>, longest: int>"
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
TYPE = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(SPAN)), ("items", pa.list_(pa.int64())), ("longest", pa.int32())])


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


@dataclass
class TestSuffixes:
    """The distinct windows of one block of the benchmark: word numbers (-1 ends an item), start and length of each window and
    the number of its set of items, these sets, and all suffixes in order."""
    vocabulary: dict[bytes, int]
    ids: np.ndarray
    start: np.ndarray
    length: np.ndarray
    named: np.ndarray
    items: list[tuple[int, ...]]
    order: np.ndarray

    @staticmethod
    def of(items: list[tuple[int | None, str | None]], window: int) -> TestSuffixes:
        vocabulary: dict[bytes, int] = {}
        ids: list[int] = []
        first: dict[tuple[int, ...], int] = {}
        holders: dict[tuple[int, ...], set[int]] = {}
        for key, text in items:
            own = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
            n = min(window, len(own))
            for k in range(len(own) - n + 1 if own else 0):
                w = tuple(own[k:k + n])
                first.setdefault(w, len(ids) + k)
                holders.setdefault(w, set()).update(() if key is None else (key,))
            ids += [*own, -1]
        sets: dict[tuple[int, ...], int] = {}
        named = [sets.setdefault(tuple(sorted(holders[w])), len(sets)) for w in first]
        t = np.array(ids, np.int64)
        return TestSuffixes(vocabulary, t, np.array(list(first.values()), np.int64), np.array(list(map(len, first)), np.int64),
                            np.array(named, np.int64), list(sets), suffix_array(np.maximum(t, 0), len(t)))


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Places of `t` with a word of the benchmark, sorted by the words that follow, at least `depth` deep. 0 in `t` is a
    word that no test suffix has, or the end of a document."""
    places = np.flatnonzero(t)
    rank, step, known = t, 1, 0
    while step < depth and known < len(places):        # all different: longer prefixes change nothing
        after = np.zeros(len(t), np.int64)
        after[:-step or None] = rank[step:]
        _, new = np.unique(rank[places] * (int(after.max(initial=0)) + 1) + after[places], return_inverse=True)
        rank = np.zeros(len(t), np.int64)
        rank[places] = new + 1
        step, known = step * 2, int(new.max(initial=-1)) + 1
    return places[np.argsort(rank[places], kind="stable")]


def edge(t: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, value: np.ndarray, after: bool) -> np.ndarray:
    """Binary search in each [low, high): the first suffix whose word is not below (or is above) the value."""
    low, high = low.copy(), high.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        word = t[at[mid]]
        down = word <= value[open_] if after else word < value[open_]
        low[open_[down]] = mid[down] + 1
        high[open_[~down]] = mid[~down]
    return low


def occurrences(t: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of every occurrence of every window in the shard."""
    depth = int(test.length.max(initial=0))
    sa = suffix_array(t, depth)
    padded = np.concatenate([t, np.zeros(depth + 1, np.int64)])
    alive = np.arange(len(test.start))
    low, high = np.zeros(len(alive), np.int64), np.full(len(alive), len(sa), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for d in range(depth):
        value, at = test.ids[test.start[alive] + d], sa + d
        low, high = edge(padded, low, high, at, value, False), edge(padded, low, high, at, value, True)
        done = test.length[alive] == d + 1
        found.append((alive[done], low[done], high[done]))
        go = (low < high) & ~done
        alive, low, high = alive[go], low[go], high[go]
    window, low, high = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    n = high - low
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(window, n), sa[np.repeat(low, n) + inside]


BASE = 0x9E3779B97F4A7C15 | 1


def run_sums(t: np.ndarray) -> np.ndarray:
    """Sums, modulo 2^64, of mixed words times powers of BASE: equal runs have equal sums but for a power of BASE."""
    x = t.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((x ^ (x >> np.uint64(29))) * powers(len(t)), dtype=np.uint64)])


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def matches(t: np.ndarray, place: np.ndarray, test: TestSuffixes) -> np.ndarray:
    """Of each place the most words from there on that stand in one item: the longest prefix shared with the suffixes of the
    benchmark on both sides of where it belongs."""
    if not len(place):
        return np.zeros(0, np.int64)
    own, theirs, power = run_sums(t), run_sums(test.ids), powers(max(len(t), len(test.ids)) + 1)

    def common(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(p), np.int64), np.minimum(len(t) - p, len(test.ids) - q)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = (own[p + mid] - own[p]) * power[q] == (theirs[q + mid] - theirs[q]) * power[p]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    a, b = np.append(t, 0), np.append(test.ids, 0)
    low, high = np.zeros(len(place), np.int64), np.full(len(place), len(test.order), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        p, q = place[open_], test.order[mid]
        n = common(p, q)
        # an item's end (-1) and a word unknown to the benchmark (0) both come before all words
        down = np.maximum(b[q + n], 0) < a[p + n]
        low[open_[down]] = mid[down] + 1
        high[open_[~down]] = mid[~down]
    best = np.zeros(len(place), np.int64)
    for side in (low - 1, low):
        ok = np.flatnonzero((side >= 0) & (side < len(test.order)))
        best[ok] = np.maximum(best[ok], common(place[ok], test.order[side[ok]]))
    return best


def shard_verdicts(texts: list[str | None], test: TestSuffixes, prior: list[dict] | None) -> pa.Array:
    """Verdicts of one shard; `prior` are those of earlier blocks of the benchmark."""
    get = test.vocabulary.get
    ids: list[int] = []
    first, count = [], []
    for text in texts:
        own = words(text)
        first.append(len(ids))
        count.append(len(own))
        ids.extend([get(w, 0) for w in own])
        ids.append(0)
    t = np.array(ids, np.int64)
    starts = np.array(first, np.int64)
    window, place = occurrences(t, test)
    doc = np.searchsorted(starts, place, side="right") - 1
    edges = np.zeros(len(t) + 1, np.int64)
    np.add.at(edges, place, 1)
    np.add.at(edges, place + test.length[window], -1)
    hit = np.cumsum(edges) > 0
    change = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    spans: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
        d = int(np.searchsorted(starts, a, side="right")) - 1
        spans.setdefault(d, []).append((a - first[d], b - first[d]))
    items: dict[int, set[int]] = {}
    for d, s in zip(*np.unique(np.stack([doc, test.named[window]]), axis=1).tolist(), strict=True) if len(doc) else ():
        items.setdefault(d, set()).update(test.items[s])
    longest = np.zeros(len(texts), np.int64)
    at = np.unique(place)
    np.maximum.at(longest, np.searchsorted(starts, at, side="right") - 1, matches(t, at, test))
    rows = []
    for d, n in enumerate(count):
        old = prior[d] if prior else None
        own_spans, own_items, own_longest = spans.get(d, []), items.get(d, set()), int(longest[d])
        if old:
            own_spans = merged(own_spans + [(s["start"], s["end"]) for s in old["spans"]])
            own_items, own_longest = own_items | set(old["items"]), max(own_longest, old["longest"])
        rows.append({"n_words": n, "spans": [{"start": a, "end": b} for a, b in own_spans], "items": sorted(own_items),
                     "longest": own_longest})
    return pa.array(rows, TYPE)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def test_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list[TestSuffixes]:
    """The benchmark in blocks of about `block_bytes` of text; one block at a time is read."""
    own = benchmark.select("item_id", "text").filter(F.length("text") > 0)
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    blocks = (own.filter(part == k).orderBy("item_id", "text").collect() for k in range(n))
    return [TestSuffixes.of([(r["item_id"], r["text"]) for r in rows], window) for rows in blocks]


def searched(text: Column, sent: Broadcast, prior: Column | None) -> Column:
    """The verdict of one block of the benchmark, merged with that of earlier blocks."""
    @F.arrow_udf(DDL)
    def first(texts: pa.Array) -> pa.Array:
        return shard_verdicts(texts.to_pylist(), sent.value, None)

    @F.arrow_udf(DDL)
    def further(texts: pa.Array, before: pa.Array) -> pa.Array:
        return shard_verdicts(texts.to_pylist(), sent.value, before.to_pylist())

    return first(text) if prior is None else further(text, prior)


def verdict(text: Column, blocks: list[TestSuffixes], spark: SparkSession) -> Column:
    """Struct n_words, spans (of words, end excluded), items and the longest verbatim match."""
    found = None
    for test in blocks:
        found = searched(text, spark.sparkContext.broadcast(test), found)      # at most block_bytes of text
    return found


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest and the hit spans of every document."""
    v = verdict(F.col("text"), test_blocks(benchmark, window, block_bytes), documents.sparkSession)
    hit = F.aggregate("v.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_sort(F.transform("v.items", lambda x: x.cast("string")))
    return documents.select("doc_id", v.alias("v")).select(
        "doc_id", "v.n_words", hit.alias("n_hit"), F.size("v.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("v.spans") > 0).alias("contaminated"),
        "v.longest", "v.spans")


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns."""
    v = verdict(F.col("text"), test_blocks(benchmark, window, block_bytes), documents.sparkSession)
    return documents.filter(F.size(v["spans"]) == 0)
