"""N-gram Jaccard join: an LSH forest of MinHash prefix tries finds candidates, exact sets of word shingles verify them.

Texts of equal shingle sets are one class and take part once. Each class has a path of `full` MinHash values in each of
`trees` tries (16 of depth 6). Prefixes are shortened level by level, from `full` on. A pair of classes is a candidate at the
length of the longest prefix they share in any trie, so at each level only nodes that branch there are opened, and each pair is
verified once. After a level every class has an estimate of its recall: the number of its verified links over the sum of
1 / p, where p = 1 - (1 - J^d)^trees is the chance by which a link of similarity J is found at depth d. A class whose recall
has reached `target` asks no further, but others may still find it; one without a link knows nothing and goes on. The least
depth is the longest by which a pair exactly at the threshold is found with probability `target` (4; 0.9998 at 0.8): there
even a class that has found nothing may stop. Every candidate is verified, so nothing false is linked. A link is lost only if
no trie brings it together before both its ends have stopped: at most 0.008 exactly at 0.8, less above.

Work on a trie node is split: a node of more than `block` classes, or of more than `block_shingles` shingles, is dealt over
blocks, and every two blocks meet in one group. So a group of thousands of near copies is many tasks, a task holds two blocks
whatever the length of the texts, and pairs are numpy matrices, never rows. A class goes to as many groups as its node has
blocks, so blocks are as large as a task may hold. A pair belongs
to the first tree that brings it together at its level. A slim pass over keys alone finds which classes have such a pair in a
group; only these meet with their shingles, computed once from the text of one document of each class in the tries. A group
returns, for each class, the number of documents linked, and edges of a spanning forest: as many rows as members at most.
Classes of linked documents are the connected components, by large-star and small-star rounds over written tables; the centre
of a star, which has an edge to each member, is joined apart (`hot`).

Words are lower-cased and split at white space; a shingle is five words, a shorter text with a word is one shingle.
Shingles and classes are compared by 64 and 128 bits of hash.

Defined results: texts without a word (null, empty, blank) link to nothing and are classes of their own; a class is named by
its least doc_id, one of only null ids by null; repeated rows are copies of each other. Only doc_id and text are read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erisk.llm.common import written
from erisk.llm.hot import components, hot_join

SHINGLE, SIMILARITY, TARGET, TREES, DEPTH, SEED = 5, 0.8, 0.999, 16, 6, 11

#: Classes and shingles of a block: two blocks are at most some 16 MB of sets, their matrices of pairs 32 MB each.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20


def depth_for(similarity: float, target: float, trees: int, depth: int) -> int:
    """The longest prefix that still finds a pair at the threshold with the target probability."""
    while depth > 1 and chance(similarity, depth, trees) < target:
        depth -= 1
    return depth


def chance(similarity: float | np.ndarray, depth: int, trees: int) -> float | np.ndarray:
    """By which a pair shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity ** depth) ** trees


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    known: dict[str, int] = {}
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
    ids = np.array([known[w] for w in words], np.uint64)
    width = min(SHINGLE, len(ids))
    n = len(ids) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + n])
    return np.unique(h)


def forest_keys(own: np.ndarray, trees: int, least: int, full: int) -> np.ndarray:
    """The trie nodes of a set: for each depth from `least` to `full` the prefix in each tree as one hash."""
    rng = np.random.default_rng(SEED)
    a, b = (rng.integers(0, 1 << 63, trees * full, np.uint64) for _ in range(2))
    a = a << np.uint64(1) | np.uint64(1)
    low = np.full(trees * full, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), 512):
        low = np.minimum(low, (own[k:k + 512, None] * a + b).min(axis=0))
    path = (low >> np.uint64(32)).reshape(trees, full)
    key, nodes = mixed(np.arange(1, trees + 1, dtype=np.uint64)), []
    for k in range(full):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + path[:, k])
        nodes.append(key)
    return np.concatenate(nodes[least - 1:]).view(np.int64)


def class_key(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def signed(text: Column, trees: int, least: int, full: int) -> Column:
    """Struct of the class, the number of shingles and the trie nodes of all depths; null class if the text has no word."""
    @F.arrow_udf("struct<c: binary, n: int, keys: array<bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        rows = [shingles(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([
            pa.array([class_key(s) for s in rows], pa.binary()), pa.array([len(s) for s in rows], pa.int32()),
            pa.array([forest_keys(s, trees, least, full) if len(s) else None for s in rows], pa.list_(pa.int64()))], ["c", "n", "keys"])
    return run(text)


def sets_of(text: Column) -> Column:
    @F.arrow_udf("struct<c: binary, own: binary>")
    def run(texts: pa.Array) -> pa.Array:
        rows = [shingles(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([class_key(s) for s in rows], pa.binary()),
                                           pa.array([s.tobytes() for s in rows], pa.binary())], ["c", "own"])
    return run(text)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups, with the bounds of the groups; the last group waits for the next batch."""
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        new[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), len(t))

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        t = pa.Table.from_batches(held).combine_chunks()
        bounds = cut(t)
        if len(bounds) > 2:
            yield t.slice(0, bounds[-2]), bounds[:-1]
            held = t.slice(bounds[-2]).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, cut(t)


GROUP = ["tree", "key", "p", "q"]
MEMBER = [*GROUP, "part", "c", "asks", "now", "deeper"]
SLIM = "tree int, key bigint, p int, q int, part int, c binary, asks boolean, now array<int>, deeper array<int>"


def own_pairs(now: np.ndarray, deeper: np.ndarray, asks: np.ndarray, part: np.ndarray, tree: int, p: int, q: int) -> np.ndarray:
    """Pairs (upper triangle) that belong to this group: between its two blocks, one of them still asking, not together in an
    earlier tree at this depth (`now`), nor in any tree one value deeper."""
    n = len(now)
    pair = np.triu(np.ones((n, n), bool), 1) & (asks[:, None] | asks[None, :])
    if p != q:
        pair &= part[:, None] != part[None, :]
    for t in range(tree):
        pair &= now[:, None, t] != now[None, :, t]
    for t in range(deeper.shape[1]):
        pair &= deeper[:, None, t] != deeper[None, :, t]
    return pair


def near_sizes(n: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(n[:, None], n[None, :]) >= similarity * np.maximum(n[:, None], n[None, :])


def list_matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1) if len(flat) else np.zeros((0, 1), np.int64)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int, np.ndarray]]]]:
    """Tables of whole groups; for each group of two or more its bounds and the matrix of its own pairs, before sizes."""
    for t, bounds in whole_groups(batches, GROUP):
        now, deeper, part = list_matrix(t.column("now")), list_matrix(t.column("deeper")), t.column("part").to_numpy()
        asks, (tree, _, p, q) = t.column("asks").to_numpy(), (t.column(k).to_numpy() for k in GROUP)
        yield t, [(a, b, own_pairs(now[a:b], deeper[a:b], asks[a:b], part[a:b], int(tree[a]), int(p[a]), int(q[a])))
                  for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if b - a > 1]


def slim_pass(similarity: float):
    """Which members of a group have a pair of their own in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, inside in groups(batches):
            n, take = t.column("n").to_numpy(), np.zeros(len(t), bool)
            for a, b, pair in inside:
                pair &= near_sizes(n[a:b], similarity)
                take[a:b] = pair.any(axis=0) | pair.any(axis=1)
            kept = t.filter(pa.array(take)).select(MEMBER)
            yield from kept.combine_chunks().to_batches()
    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a group's sets: products of 0/1 matrices over the shingles that two sets share."""
    n = len(sets)
    if n == 2:
        return np.full((2, 2), len(np.intersect1d(*sets, assume_unique=True)), np.int64)
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    use = shared[code]
    row, code = row[use], column[code[use]]
    # a product of at most 4 million columns is exact in float32; sums of them are kept whole
    total, wide = np.zeros((n, n), np.int64), max(1, 8_000_000 // n)
    for a in range(0, int(shared.sum()), wide):
        x, part = np.zeros((n, min(wide, int(shared.sum()) - a)), np.float32), (code >= a) & (code < a + wide)
        x[row[part], code[part] - a] = 1
        total += (x @ x.T).astype(np.int64)
    return total


def spanning(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Each member with the least member it is linked to through any path; pairs as rows (i, j)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in root]


LINKS = "c binary, other binary, links bigint, pairs bigint, expected array<double>"


def verify_pass(similarity: float, trees: int, depths: list[int]):
    """Of each member with a link in this group: linked documents, linked classes, the sum of 1 / p over them for each of
    `depths`, and one edge towards the rest of its component."""
    schema = pa.schema([("c", pa.binary()), ("other", pa.binary()), ("links", pa.int64()), ("pairs", pa.int64()), ("expected", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, inside in groups(batches):
            size, c, own = t.column("size").to_numpy(), t.column("c").to_pylist(), t.column("own").to_pylist()
            out: list[tuple[bytes, bytes, int, int, list[float]]] = []
            for a, b, pair in inside:
                sets = [np.frombuffer(x, np.uint64) for x in own[a:b]]
                n = np.array([len(s) for s in sets])
                pair &= near_sizes(n, similarity)
                if not pair.any():
                    continue
                both = intersections(sets)
                total = n[:, None] + n[None, :]
                # J >= s is |A and B| >= s / (1 + s) * (|A| + |B|); a hair is left for rounding
                pair &= both * (1 + similarity) >= similarity * total - 1e-6
                linked = np.argwhere(pair)
                if len(linked):
                    m = size[a:b]
                    links, count = pair @ m + pair.T @ m, pair.sum(axis=0) + pair.sum(axis=1)
                    i, j = linked.T
                    alike = both[i, j] / (total[i, j] - both[i, j])
                    expected = np.zeros((b - a, len(depths)))
                    for k, d in enumerate(depths):
                        w = 1 / chance(alike, d, trees)
                        np.add.at(expected[:, k], i, w)
                        np.add.at(expected[:, k], j, w)
                    out += [(c[a + x], c[a + r], int(links[x]), int(count[x]), expected[x].tolist()) for x, r in spanning(linked)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    return run


class Join:
    """The join's tables: `rows` (row, doc_id, c of every document), `classes` (c, size, best) and `linked` (c, links, root)."""

    def __init__(self, documents: DataFrame, similarity: float = SIMILARITY, target: float = TARGET, trees: int = TREES, full: int = DEPTH,
                 block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES):
        least = depth_for(similarity, target, trees, full)
        own = documents.select("doc_id", "text", row_key().alias("row"))
        rows = written(own.select("row", "doc_id", signed(F.col("text"), trees, least, full).alias("s")).select("row", "doc_id", "s.*"), "signatures")
        self.rows = rows.select("row", "doc_id", "c")
        self.classes = written(rows.filter("c IS NOT NULL").groupBy("c").agg(
            F.count("*").alias("size"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"),
            F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")

        def nodes(depth: int) -> Column:
            return F.slice("keys", (depth - least) * trees + 1, trees) if depth <= full else F.array().cast("array<bigint>")

        # the tries: classes that share a node of the least depth; most classes share none
        entries = self.classes.select("c", F.explode(nodes(least)).alias("key"))
        shared = written(entries.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "shared")
        inside = hot_join(entries, shared, "key", "members").select("c").distinct()
        forest = written(inside.join(self.classes, "c").select("c", "n", "size", F.col("best.row").alias("row"), "keys"), "forest")
        # both sides grow with the corpus, so neither is ever broadcast
        texts = own.join(forest.select("c", "size", "row").hint("merge"), "row").dropDuplicates(["row"])
        texts = written(texts.select("c", "size", sets_of(F.col("text"))["own"].alias("own")), "sets")
        depths = list(range(full, least - 1, -1))
        verified: DataFrame | None = None
        for k, depth in enumerate(depths):
            level = forest.select("c", "n", nodes(depth).alias("keys"), nodes(depth + 1).alias("below"))
            level = level.withColumns({"now": high_bits("keys"), "deeper": high_bits("below")})
            if verified is None:
                level = level.withColumn("asks", F.lit(True))
            else:
                recall = verified.groupBy("c").agg((F.sum("pairs") / F.sum(F.col("expected")[k - 1])).alias("recall"))
                stopped = recall.filter(F.col("recall") >= target).select("c", F.lit(False).alias("asks"))
                level = written(level.join(stopped, "c", "left").withColumn("asks", F.coalesce("asks", F.lit(True))), "level")
            found = self.level(level, texts, (block, block_shingles), similarity, trees, depths)
            verified = found if verified is None else verified.union(found)
        roots = components(verified.select("c", "other"))
        links = verified.groupBy("c").agg(F.sum("links").alias("links"))
        self.linked = written(links.join(roots, "c", "left").select("c", "links", F.coalesce("root", "c").alias("root")), "linked")

    @staticmethod
    def level(level: DataFrame, texts: DataFrame, block: tuple[int, int], similarity: float, trees: int, depths: list[int]) -> DataFrame:
        """The verified pairs of one depth of the tries: those whose longest common prefix has this depth."""
        n_tasks = int(level.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # an entry carries what its group needs, so that only the key is joined
        entries = level.select("c", "n", "asks", "now", "deeper", "below", F.posexplode("keys").alias("tree", "key"))
        entries = entries.withColumn("child", F.when(F.size("below") > 0, F.get("below", F.col("tree")))).drop("below")
        node = entries.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), F.max("asks").alias("asked"),
                                          F.min("child").alias("low"), F.max("child").alias("high"))
        node = node.filter("members > 1 AND asked AND (low IS NULL OR low <> high)")        # a node of one child parts no pair
        blocks = F.least(F.greatest(F.ceil(F.col("members") / block[0]), F.ceil(F.col("shingles") / block[1])), F.col("members"))
        node = written(node.select("key", "members", blocks.cast("int").alias("blocks")), "nodes")
        part = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
        met = hot_join(entries.drop("child"), node, "key", "members")
        met = met.withColumn("part", part).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.select("tree", "key", F.least("part", "x").alias("p"), F.greatest("part", "x").alias("q"), "part", "c", "n", "now", "deeper", "asks")
        needed = written(grouped(met, n_tasks).mapInArrow(slim_pass(similarity), SLIM), "needed")
        members = needed.join(texts, "c")
        return written(grouped(members, n_tasks).mapInArrow(verify_pass(similarity, trees, depths), LINKS), "links")

    def documents(self) -> DataFrame:
        """doc_id, class_id (the least doc_id of its near-duplicate class) and n_links (other documents it is linked to)."""
        whole = self.classes.join(self.linked, "c", "left").withColumn("root", F.coalesce("root", "c"))
        names = whole.groupBy("root").agg(F.min("best")["doc_id"].alias("class_id"), F.sum("size").alias("class_size"))
        per_class = written(whole.join(names, "root").select(
            "c", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")), "verdicts")
        return self.rows.join(per_class, "c", "left").select(
            "doc_id", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"))

    def kept_rows(self) -> DataFrame:
        """row, stays and copies of the documents of classes of two or more; the one of least doc_id stays."""
        whole = self.classes.join(self.linked, "c", "left").select("c", "size", "best", F.coalesce("root", "c").alias("root"))
        groups = whole.groupBy("root").agg(F.sum("size").alias("total"), F.min("best")["row"].alias("first")).filter("total > 1")
        first = whole.select("c", "root").join(groups, "root").select("c", "first")
        mine = self.rows.filter("c IS NOT NULL").join(first, "c").select("row", (F.col("row") == F.col("first")).alias("stays"))
        return mine.groupBy("row").agg(F.first("stays").alias("stays"), F.count("*").alias("copies"))


def high_bits(keys: str) -> Column:
    """Half of each key: enough to tell whether two paths agree (a false agreement has a chance of 2^-32), at half the shuffle."""
    return F.transform(keys, lambda k: F.shiftright(k, 32).cast("int"))


def grouped(members: DataFrame, n_tasks: int) -> DataFrame:
    return members.repartition(n_tasks, *GROUP).sortWithinPartitions(*GROUP)


def row_key() -> Column:
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))).cast("binary")))


def joined(documents: DataFrame, similarity: float = SIMILARITY, target: float = TARGET) -> DataFrame:
    return Join(documents, similarity, target).documents()


def one_of_each(documents: DataFrame, similarity: float = SIMILARITY, target: float = TARGET) -> DataFrame:
    """The documents less all but one of each near-duplicate class: the one of least doc_id stays. All columns are kept."""
    fate = written(Join(documents, similarity, target).kept_rows(), "fates")
    # the fates grow with the corpus: never a broadcast, so any size takes the same way; the input's columns are one struct, so
    # they may have any name
    own = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("d"), row_key().alias("row"))
    own = own.join(fate.hint("merge"), "row", "left").filter("stays IS NULL OR stays")
    if fate.filter("stays AND copies > 1").isEmpty():        # the usual table: no row is there twice
        return own.select("d.*")
    once = own.filter(F.coalesce("copies", F.lit(1)) == 1).select("d.*")
    return once.union(own.filter("copies > 1").dropDuplicates(["row"]).select("d.*"))
