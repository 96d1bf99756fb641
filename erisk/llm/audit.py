"""Filter interaction audit: a table-driven byte transducer reads each text once, counts cells of failed filters replay all orders.

The transducer is a finite-state machine over UTF-8 bytes with two states, outside and inside a word. Two tables drive it:
`CLASS` maps a byte to one of six classes, `ACTION` maps (state, class) to the start or end of a word. One pass counts words,
capitals, code points and symbols, and puts each finished word span into an open-addressing hash table in which every hit is
verified byte by byte, so distinct words are exact. A whole Arrow batch is one byte stream read in blocks; the state, an open
word and the table entries of an open text carry over to the next block, so a very long text needs no larger block.

Filters A to D follow from the counts, E (identical to the text of a smaller doc_id) from the least doc_id of each text. Rows
then fold to one count per (part, set of failed filters): at most 32 rows a part, from which every order and step is computed.
Texts themselves are never shuffled; equal texts are known by SHA-256, and counted before the shuffle, so copies that are a
third of all rows do no harm.

Defined results: a null text is empty (no words: it fails A alone, and E if another text is empty); a null lang is the part ''.
A row with a null doc_id is never after, nor before, another one, so it does not fail E. Several label rows of one doc_id count
as good or toxic if one of them says so; a document without label is neither. Repeated rows all count. An empty table has no
parts and no rows. Only doc_id, lang and text are read.
"""
from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erisk.llm.common import written

SYMBOLS = b"#$%&*|"
SPACE, LETTER, CAPITAL, SYMBOL, TAIL, LEAD = range(6)
OUTSIDE, INSIDE = 0, 1
NOTHING, START, END = 0, 1, 2
BLOCK, LONG_WORD = 1 << 20, 256
FILTERS = "ABCDE"


def byte_classes() -> np.ndarray:
    """The class of each byte: white space, other ASCII, capital, symbol, UTF-8 continuation, UTF-8 lead."""
    c = np.full(256, LETTER, np.uint8)
    c[[0x20, *range(0x09, 0x0E)]] = SPACE
    c[ord("A"):ord("Z") + 1] = CAPITAL
    c[list(SYMBOLS)] = SYMBOL
    c[0x80:0xC0], c[0xC0:] = TAIL, LEAD
    return c


CLASS = byte_classes()
#: The state after a byte of each class, and what (state, class) does.
NEXT = np.array([OUTSIDE] + [INSIDE] * 5, np.uint8)
ACTION = np.array([[NOTHING] + [START] * 5, [END] + [NOTHING] * 5], np.uint8)


class Spans:
    """Word spans of a byte stream with their text's number and hash; the stream is padded by 8 bytes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray):
        self.data, self.start, self.end, self.owner = data, start, end, owner
        self.word = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))     # the 8 bytes from any place
        self.hash = self.hashed()

    def eight(self, which: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 8 of each span, zero beyond its end."""
        left = np.minimum(self.end[which] - self.start[which] - 8 * k, 8).astype(np.uint64)
        return self.word[self.start[which] + 8 * k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))

    def hashed(self) -> np.ndarray:
        size = self.end - self.start
        h = mix(self.owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64))
        short = np.flatnonzero(size <= LONG_WORD)
        k = 0
        while len(short):
            h[short] = mix(h[short] ^ self.eight(short, k))
            k += 1
            short = short[size[short] > 8 * k]
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            h[i] ^= np.uint64(xxhash.xxh64_intdigest(self.data[self.start[i]:self.end[i]]))
        return h

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans a and b are the same word of the same text, by their bytes."""
        size = self.end[a] - self.start[a]
        equal = (self.hash[a] == self.hash[b]) & (size == self.end[b] - self.start[b]) & (self.owner[a] == self.owner[b])
        left = np.flatnonzero(equal & (a != b) & (size <= LONG_WORD))
        k = 0
        while len(left):
            differ = self.eight(a[left], k) != self.eight(b[left], k)
            equal[left[differ]] = False
            k += 1
            left = left[~differ & (size[left] > 8 * k)]
        for i in np.flatnonzero(equal & (a != b) & (size > LONG_WORD)).tolist():
            equal[i] = np.array_equal(self.data[self.start[a[i]]:self.end[a[i]]], self.data[self.start[b[i]]:self.end[b[i]]])
        return equal

    def distinct(self) -> np.ndarray:
        """Numbers of the spans that own a slot of the hash table: the first of each word of each text, in order."""
        n = len(self.start)
        mask = (1 << max(4, int(2 * n).bit_length())) - 1
        slots, at, waiting = np.full(mask + 1, -1, np.int64), (self.hash & np.uint64(mask)).astype(np.int64), np.arange(n)
        while len(waiting):
            place = at[waiting]
            free = slots[place] < 0
            slots[place[free][::-1]] = waiting[free][::-1]         # the first of those that want a slot gets it
            waiting = waiting[~self.same(waiting, slots[place])]
            at[waiting] = (at[waiting] + 1) & mask
        return np.sort(slots[slots >= 0])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


COUNTS = ["n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols"]


def transduce(texts: pa.Array, block: int = BLOCK) -> dict[str, np.ndarray]:
    """The five counts of each text. A blank after each text ends its last word."""
    ended = pc.binary_join_element_wise(pc.fill_null(texts, "").cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    n = len(ended)
    out = {c: np.zeros(n, np.int64) for c in COUNTS}
    if not n:
        return out
    bound = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset:ended.offset + n + 1]
    data = np.concatenate([np.frombuffer(ended.buffers()[2], np.uint8)[bound[0]:bound[-1]], np.zeros(8, np.uint8)])
    bound = bound - bound[0]
    state, open_word, kept = OUTSIDE, np.zeros(0, np.int64), np.zeros((3, 0), np.int64)
    for a in range(0, int(bound[-1]), block):
        b = min(a + block, int(bound[-1]))
        kind = CLASS[data[a:b]]
        after = NEXT[kind]
        before = np.empty_like(after)
        before[0], before[1:] = state, after[:-1]
        state = int(after[-1])
        action = ACTION[before, kind]
        start = np.concatenate([open_word, np.flatnonzero(action == START) + a])
        end = np.flatnonzero(action == END) + a
        start, open_word = start[:len(end)], start[len(end):]
        first, last = (int(np.searchsorted(bound, x, "right")) - 1 for x in (a, b - 1))
        cuts = np.maximum(bound[first:last + 1], a) - a
        for name, hit in (("n_capitals", kind == CAPITAL), ("n_symbols", kind == SYMBOL), ("n_chars", kind != TAIL)):
            out[name][first:last + 1] += np.add.reduceat(hit, cuts, dtype=np.int64)
        owner = np.searchsorted(bound, start, "right") - 1
        out["n_words"] += np.bincount(owner, minlength=n)
        spans = Spans(data, *np.concatenate([kept, np.array([start, end, owner], np.int64).reshape(3, -1)], axis=1))
        own = spans.distinct()
        out["n_distinct"] += np.bincount(spans.owner[own[own >= kept.shape[1]]], minlength=n)
        own = own[spans.owner[own] == last]                        # only the text that the block ends in goes on
        kept = np.array([spans.start[own], spans.end[own], spans.owner[own]])
    out["n_chars"] -= 1
    return out


def text_counts(text: Column) -> Column:
    """Struct of the five counts of a whole text."""
    @F.arrow_udf("struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">")
    def counts(texts: pa.Array) -> pa.Array:
        found = transduce(texts)
        return pa.StructArray.from_arrays([pa.array(found[c], pa.int64()) for c in COUNTS], COUNTS)
    return counts(text)


def own_failures(s: str) -> Column:
    """Filters A to D as bits 1, 2, 4 and 8."""
    n, distinct, capitals, chars, symbols = (F.col(f"{s}.{c}") for c in COUNTS)
    rules = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * chars, symbols > 0]
    return sum((F.when(r, 1 << k).otherwise(0) for k, r in enumerate(rules[1:], 1)), F.when(rules[0], 1).otherwise(0))


def failed_sets(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of the failed filters A to E) with n, good and toxic: numbers of documents."""
    read = documents.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_counts(F.col("text")).alias("s"),
                            F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("same"))
    rows = read.select("doc_id", "part", "same", own_failures("s").alias("fails"))
    rows = written(rows.groupBy("doc_id", "part", "same", "fails").agg(F.count("*").alias("n")), "audit")
    # one row a text: its least doc_id, found before the shuffle; the join is on (text, doc_id), which copies do not share
    least = rows.filter("doc_id IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("least", F.lit(True))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    all_ = rows.join(least, ["same", "doc_id"], "left").join(marks, "doc_id", "left")
    later = F.col("doc_id").isNotNull() & F.col("least").isNull()
    return all_.groupBy("part", (F.col("fails") + F.when(later, 16).otherwise(0)).alias("fails")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def audited(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    A document is removed by the first of its failed filters in an order. Among the orders each of its k failed filters comes
    first equally often, so it adds 120 / k to the shapley count of each.
    """
    orders = F.array(*(F.lit("".join(p)) for p in itertools.permutations(FILTERS)))
    steps = (failed_sets(documents, labels).withColumn("filter_order", F.explode(orders))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))))
    bits = "+".join(f"if(locate('{f}', substring(filter_order, 1, step - 1)) > 0, {1 << k}, 0)" for k, f in enumerate(FILTERS))
    steps = steps.withColumns({"own": F.expr("shiftleft(1, ascii(substring(filter_order, step, 1)) - ascii('A'))"), "before": F.expr(bits)})
    fails, own, early = F.col("fails"), F.col("own"), F.col("fails").bitwiseAND(F.col("before")) > 0
    here = fails.bitwiseAND(own) > 0

    def total(condition: Column, count: Column | str = "n") -> Column:
        return F.sum(F.when(condition, F.col(count) if isinstance(count, str) else count).otherwise(0)).cast("bigint")

    return steps.groupBy("part", "filter_order", "step").agg(
        total(~early & ~here).alias("kept"), total(~early & here).alias("removed"), total(early & here).alias("redundant"),
        total(fails == own).alias("unique_fails"), total(~early & here, "good").alias("good_lost"),
        total(~early & here, "toxic").alias("toxic_lost"),
        total(here, F.col("n") * F.expr(f"{len(list(itertools.permutations(FILTERS)))} div bit_count(fails)")).alias("shapley"))
