"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked within a Hamming distance by pigeonring filtering.

The 64 bits are a ring of tau + 1 segments. If two fingerprints differ in at most tau bits, then from some segment on every
chain of l consecutive segments differs in at most l - 1 bits (the budget in proportion, l tau / (tau + 1), rounded down): the
first is equal, the first two differ in one bit at most, and so on round the ring. So candidates share a segment; then each
longer chain must stay within its budget, and only those that pass have all bits counted.

Equal fingerprints are one node from the start, so exact copies cost nothing later. Nodes are dealt by (segment number, its
bits). A bucket of at most `limit` nodes is searched in one task, sorted, each shift of all buckets in one numpy step. A larger
one is dealt again by the longer chain: its members by each way to leave one bit of the next segment open, then by each
way to leave two bits of the third open. Both follow from the budgets, so no link is lost. Buckets at the second depth that
are still large are dense: there nodes one bit apart are joined first (63 equal bits, a plain grouping), and a bucket whose
nodes are already one component has nothing left to find. A bucket of the third depth has 46 equal bits, hence 2^18 nodes at
most. A search only returns edges that join two trees: fewer than the bucket has nodes.

Components come by star rounds over these edges; a node is (doc_id, fingerprint) with its least doc_id, so the least node of a
component names it and no further join is needed.

A word is `[^\\x20\\x09-\\x0D]+` after A-Z become a-z. A shingle is three words joined by blanks, repeats count, a shorter text is
one shingle. A bit is 1 if it is set in more than half of the shingles' XXH64 (seed 42).

Defined results: a text without words (null, empty, blank) has the fingerprint zero and is linked like any other. A null doc_id
is above every other; a component of only such rows has a null name. Repeated rows each give a row. An empty table gives
none. Only doc_id and text are read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from erisk.llm.common import written
from erisk.llm.hot import components, hot_join
from erisk.llm.jaccard import whole_groups

SHINGLE, SEED, DISTANCE, LIMIT, BITS = 3, 42, 3, 1024, 64


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    words = text.encode("utf-8", "replace").lower().split() if text else []      # bytes: only ASCII letters and blanks count
    if not words:
        return 0
    width = min(width, len(words))
    joined = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    total, n = np.zeros(BITS, np.int64), len(words) - width + 1
    left = n
    while left:
        size = min(left, 1 << 14)
        h = np.fromiter((xxhash.xxh64_intdigest(next(joined), SEED) for _ in range(size)), np.dtype("<u8"), size)
        total += np.unpackbits(h.view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= size
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprinted(text: Column, width: int = SHINGLE) -> Column:
    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, width) for t in texts.to_pylist()], np.uint64).view(np.int64), pa.int64())
    return run(text)


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment of the ring."""
    cut = [BITS * k // (distance + 1) for k in range(distance + 2)]
    return [(a, b - a) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def unsigned_mask(bits: list[int]) -> int:
    """A 64-bit mask as the signed number that Spark keeps."""
    m = sum(1 << b for b in bits)
    return m - (1 << BITS) if m >> (BITS - 1) else m


def openings(at: int, bits: int, n: int) -> list[int]:
    """Masks of all ways to leave n bits of a segment open: the bits that must be equal."""
    every = range(at, at + bits)
    if n == 0 or bits <= n:
        return [unsigned_mask(list(every))] if n == 0 else [0]
    if n == 1:
        return [unsigned_mask([b for b in every if b != x]) for x in every]
    return [unsigned_mask([b for b in every if b not in (x, y)]) for x in every for y in every if x < y]


def masks(distance: int, depth: int) -> list[list[int]]:
    """For each start of the ring, the masks of equal bits of chains of `depth` segments."""
    ring = segments(distance)
    out = []
    for i in range(len(ring)):
        own = [0]
        for k in range(min(depth, len(ring))):
            own = [a | b for a in own for b in openings(*ring[(i + k) % len(ring)], k)]
        out.append(own)
    return out


def linked_pairs(fp: np.ndarray, bucket: np.ndarray, start: np.ndarray, tree: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Pairs of rows that join the trees of each bucket into its components; rows sorted by bucket."""
    ring = segments(distance)
    mask = [np.uint64(sum(1 << b for b in range(a, a + n))) for a, n in ring]
    chain = np.array([[mask[(i + k) % len(ring)] for k in range(len(ring))] for i in range(len(ring))], np.uint64)
    parent = np.arange(len(fp))
    # rows of one known component of one bucket are one tree from the start
    order = np.lexsort((tree, bucket))
    again = (np.diff(bucket[order]) == 0) & (np.diff(tree[order]) == 0)
    head = np.maximum.accumulate(np.where(np.append(True, ~again), np.arange(len(fp)), 0))
    parent[order] = order[head]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found, rows, shift = [], np.arange(len(fp)), 0
    while len(rows):
        shift += 1
        rows = rows[rows + shift < len(fp)]
        rows = rows[bucket[rows + shift] == bucket[rows]]
        near = rows[parent[rows] != parent[rows + shift]]
        differ = fp[near] ^ fp[near + shift]
        spent = np.zeros(len(near), np.uint8)
        for k in range(1, len(ring)):                       # the first segment of the chain is equal in a bucket
            spent += np.bitwise_count(differ & chain[start[near], k])
            go = spent <= k
            near, differ, spent = near[go], differ[go], spent[go]
        near = near[np.bitwise_count(differ) <= distance]
        merged = False
        for a, b in zip(near.tolist(), (near + shift).tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((a, b))
                merged = True
        while merged and not np.array_equal(up := parent[parent], parent):
            parent = up
    return found


def search(distance: int):
    """Edges of the buckets of each task."""
    schema = pa.schema([("a", pa.int64()), ("a_id", pa.int64()), ("b", pa.int64()), ("b_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, ["start", "mask", "bits"]):
            fp = t.column("fp").to_numpy().view(np.uint64)
            bucket = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            pairs = linked_pairs(fp, bucket, t.column("start").to_numpy(), t.column("tree").to_numpy(), distance)
            if pairs:
                a, b = (pa.array(x, pa.int64()) for x in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in (
                    t.column("fp").take(a), t.column("doc_id").take(a), t.column("fp").take(b), t.column("doc_id").take(b))], schema=schema)
    return run


EDGES = "a bigint, a_id bigint, b bigint, b_id bigint"
KEY = ["start", "mask", "bits"]


def node(fp: str, doc_id: str) -> Column:
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp"))


class Links:
    """Edges between the nodes (fp, doc_id) within the distance, enough to join each component."""

    def __init__(self, nodes: DataFrame, distance: int = DISTANCE, limit: int = LIMIT):
        self.distance, self.limit = distance, limit
        self.n_tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        first = self.dealt(nodes.withColumn("tree", F.col("fp")), 1)
        small, large, any_large = self.split(first)
        edges = [self.searched(small)]
        if any_large:
            members = written(large.select("start", "fp", "doc_id", "tree"), "members")
            small, large, any_large = self.split(self.dealt(members, 2))
            edges.append(self.searched(small))
        if any_large:
            dense = written(large, "dense")
            near, tree = self.one_bit(dense.select("fp", "doc_id").distinct())
            edges.append(near)
            dense = dense.drop("tree").join(tree, "fp", "left").withColumn("tree", F.coalesce("tree", "fp"))
            apart = dense.groupBy(*KEY).agg(F.min("tree").alias("low"), F.max("tree").alias("high")).filter("low < high").select(*KEY)
            dense = dense.join(apart, KEY, "left_semi")
            edges.append(self.searched(self.dealt(dense.select("start", "fp", "doc_id", "tree").distinct(), 3)))
        self.edges = edges[0]
        for e in edges[1:]:
            self.edges = self.edges.union(e)

    def dealt(self, members: DataFrame, depth: int) -> DataFrame:
        """Members once for each mask of chains of `depth` segments, of their own start or of all."""
        own = masks(self.distance, depth)
        if depth == 1:
            members = members.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(len(own) - 1))))
        table = F.array(*(F.array(*(F.lit(m).cast("bigint") for m in x)) for x in own))
        return members.withColumn("mask", F.explode(F.element_at(table, F.col("start") + 1))).withColumn("bits", F.expr("fp & mask"))

    def split(self, entries: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
        """Entries of buckets that one task searches, those of larger ones, and whether there are any of these."""
        key = F.struct(*KEY).alias("key")
        sizes = written(entries.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").withColumn("large", F.col("n") > self.limit), "buckets")
        met = written(hot_join(entries.withColumn("key", key), sizes, "key", "n").drop("key"), "entries")
        return met.filter("NOT large").drop("large"), met.filter("large").drop("large"), not sizes.filter("large").isEmpty()

    def searched(self, entries: DataFrame) -> DataFrame:
        """Edges found in whole buckets."""
        return written(entries.repartition(self.n_tasks, *KEY).sortWithinPartitions(*KEY, "fp").select(
            *KEY, "fp", "doc_id", "tree").mapInArrow(search(self.distance), EDGES), "edges")

    def one_bit(self, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Edges between nodes one bit apart, and fp -> tree, the components of these."""
        near = F.array(*(F.lit(m).cast("bigint") for m in openings(0, BITS, 1)))
        keys = members.withColumn("mask", F.explode(near)).withColumn("bits", F.expr("fp & mask"))
        two = keys.groupBy("mask", "bits").agg(F.min(F.struct("fp", "doc_id")).alias("a"), F.max(F.struct("fp", "doc_id")).alias("b"))
        edges = written(two.filter("a.fp < b.fp").select(
            F.col("a.fp").alias("a"), F.col("a.doc_id").alias("a_id"), F.col("b.fp").alias("b"), F.col("b.doc_id").alias("b_id")), "near")
        return edges, components(edges.select("a", "b")).toDF("fp", "tree")


def deduplicated(documents: DataFrame, distance: int = DISTANCE, width: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id that links lead to, of every document."""
    rows = written(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), fingerprinted(F.col("text"), width).alias("fp")), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "nodes")
    edges = Links(nodes.drop("n"), distance, limit).edges
    roots = components(edges.select(node("a", "a_id"), node("b", "b_id"))).select(
        F.col("c.fp").alias("fp"), F.lit(True).alias("joined"), F.col("root.doc_id").alias("name"))
    named = written(nodes.join(roots, "fp", "left").select("fp", "n", F.when(F.col("joined"), F.col("name")).otherwise(F.col("doc_id")).alias("component_id")), "named")
    return hot_join(rows, named, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
