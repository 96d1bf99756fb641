"""Conversation prefix trie by truncation peeling.

A conversation is the path of its turns; a turn is the digest of its role and text, so a path sorts by its prefixes and texts
are never shuffled. Equal paths fold to one row before anything is sorted. Paths are dealt by range, and each task peels its own:
from the greatest depth down it merges the paths that end at this depth with the nodes that survived from below, gives each
merged node its members, children, leaves and savings, then strips the last turn and groups again by the shorter prefix. As
rows are sorted, a group is a run, and a level is a few numpy sums over the nodes alive: nodes are found and aggregated in
one pass, and the work is their number, not depth times conversations.

Only prefixes of the first or the last path of a task may go on in another task. Of these at most two paths of nodes per task
are handed on as partial sums (everything below them is finished) and peeled once more, together, in one small task: two
times tasks times depth rows, whatever the size of the table. So a first turn that a third of all conversations share is spread over many
tasks. Nodes below such a prefix get their parent's name by `hot_join`.

`rebuilt` gives each conversation c the first h turns of conversation c - c % group, then its own turns after the first h.

Defined results: turns are taken by number, null first, ties by the digest of role and text; null role or text is empty; equal
rows are two turns. Rows with a null conv_id belong to no conversation. A conversation is held as one row of 16 bytes and a
length per turn, and one node's own list of conv_ids is hashed by one task in blocks of `ID_BLOCK` numbers, since SHA-256 is a chain. An empty
table has no nodes. Other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erisk.llm.common import written
from erisk.llm.hot import hot_join

GROUP, HEADS, ID_BLOCK, WIDTH = 5, 9, 8192, 16
#: Columns of a node while it is peeled; key and parent are digests of the path and of the path one turn shorter.
NODE = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("partial", pa.bool_()), ("conv_id", pa.int64()), ("depth", pa.int64()),
                  ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                  ("saved_tokens", pa.int64()), ("size", pa.int64()), ("ends_sha256", pa.string())])
NODE_DDL = ("key binary, parent binary, partial boolean, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
            "n_children bigint, n_leaves bigint, saved_tokens bigint, size bigint, ends_sha256 string")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_key(role: str = "role", text: str = "text") -> Column:
    """Digest of role and text, null as empty; the length of the role keeps the two apart."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    return F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"))


def heads(conv_id: Column, choices: int = HEADS) -> Column:
    """How many turns a conversation takes from the first of its group."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % choices).cast("int")


def rebuilt(conversations: DataFrame, group: int = GROUP) -> DataFrame:
    """conv_id, path (16 bytes a turn) and sizes (UTF-8 bytes of each turn's text) of every conversation, from one shuffle.

    Rows move once, to their group of conversations; a group holds at most `group` of them.
    """
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), (F.col("conv_id") - F.col("conv_id") % group).cast("bigint").alias("base"),
        F.struct(F.col("turn").alias("turn"), turn_key().alias("key"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size")).alias("t"))
    own = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    groups = own.groupBy("base").agg(F.collect_list(F.struct("conv_id", "turns")).alias("members"))
    each = groups.select(F.expr("get(filter(members, m -> m.conv_id = base), 0).turns").alias("first"), F.explode("members").alias("m"))
    h, empty = heads(F.col("m.conv_id")), F.expr("slice(m.turns, 1, 0)")
    path = F.concat(F.coalesce(F.slice("first", F.lit(1), h), empty), F.slice("m.turns", h + 1, F.size("m.turns")))
    return each.select(F.col("m.conv_id").alias("conv_id"), path.alias("p")).select(
        "conv_id", F.unhex(F.array_join("p.key", "")).alias("path"), F.col("p.size").alias("sizes"))


def distinct_paths(paths: DataFrame) -> DataFrame:
    """Equal paths as one row for each block of conversation numbers: how many, the least, and their sorted list as text."""
    return paths.groupBy("path", F.floor(F.col("conv_id") / ID_BLOCK).alias("block")).agg(
        F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("sizes").alias("sizes"),
        F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // WIDTH
    if a[:n * WIDTH] == b[:n * WIDTH]:
        return n
    differ = np.frombuffer(a, np.uint64, 2 * n) != np.frombuffer(b, np.uint64, 2 * n)
    return int(differ.argmax()) // 2


def key_of(path: bytes) -> bytes:
    return hashlib.md5(path).digest()


class Paths:
    """Sorted distinct paths of one task, read batch by batch; the digest of a path's conversation numbers grows block by block."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.path: list[bytes] = []
        n, least, ends, sizes, lcp = [], [], [], [], []
        running = None
        for b in batches:
            for path, count, conv, ids, size in zip(*(b.column(c).to_pylist() for c in ("path", "n", "conv_id", "ids")), b.column("sizes"), strict=True):
                if self.path and path == self.path[-1]:
                    running.update(b"," + ids.encode())
                    ends[-1], n[-1], least[-1] = running.hexdigest(), n[-1] + count, min(least[-1], conv)
                    continue
                running = hashlib.sha256(ids.encode())
                lcp.append(common_turns(self.path[-1], path) if self.path else -1)
                self.path.append(path)
                n.append(count)
                least.append(conv)
                ends.append(running.hexdigest())
                sizes.append(size.values.to_numpy(zero_copy_only=False).astype(np.int64))
        self.n, self.least, self.ends = np.array(n, np.int64), np.array(least, np.int64), ends
        self.lcp = np.array(lcp, np.int64)
        self.length = np.array([len(p) // WIDTH for p in self.path], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.size = np.concatenate([*sizes, np.zeros(0, np.int64)])


def node_rows(**columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in NODE], schema=NODE)


def peeled(p: Paths) -> Iterator[pa.RecordBatch]:
    """Every node of the task's paths, one level at a time from the deepest; a finished node waits for its parent's name."""
    by_length = np.argsort(p.length, kind="stable")
    upto = len(by_length)
    # the nodes alive: first row, members, least conversation, leaves and savings below
    row = n = least = leaves = saved = np.zeros(0, np.int64)
    waiting: dict | None = None
    last = len(p.path) - 1
    for depth in range(int(p.length.max()), -1, -1):
        low = int(np.searchsorted(p.length[by_length[:upto]], depth))
        ended = np.sort(by_length[low:upto])
        upto = low
        new = len(ended)
        rows = np.concatenate([ended, row])
        order = np.argsort(rows, kind="stable")             # a path that ends here comes before its extensions
        rows, child = rows[order], order >= new
        head = p.lcp[rows] < depth
        head[0] = True
        first = np.flatnonzero(head)

        def total(a: np.ndarray, b: np.ndarray, how: np.ufunc, order: np.ndarray = order, first: np.ndarray = first) -> np.ndarray:
            return how.reduceat(np.concatenate([a, b])[order], first)

        none = np.zeros(new, np.int64)
        up = (np.cumsum(head) - 1)[child]                     # the node that each node alive is a child of
        n_all, conv = total(p.n[ended], n, np.add), total(p.least[ended], least, np.minimum)
        shut = np.zeros(0, bool) if waiting is None else ~waiting["partial"]
        children = total(none, shut.astype(np.int64), np.add)
        below_leaves, below_saved = total(none, np.where(shut, leaves, 0), np.add), total(none, np.where(shut, saved, 0), np.add)
        top = rows[first]
        size = p.size[p.at[top] + depth - 1] if depth else np.zeros(len(top), np.int64)
        partial = top == 0
        if p.length[last] >= depth:
            partial[-1] = True
        any_child = total(none, np.ones(len(row), np.int64), np.add) > 0
        leaves = np.where(any_child | partial, below_leaves, 1)
        saved = np.where(partial, below_saved, below_saved + (n_all - 1) * size)
        ends = [p.ends[r] if p.length[r] == depth else NO_ENDS for r in top.tolist()]
        if waiting is not None:
            yield named(p, waiting, up, conv, partial, depth)
        waiting = {"row": top, "partial": partial, "conv_id": conv, "depth": depth + np.zeros_like(top), "n_convs": n_all, "n_children": children,
                   "n_leaves": leaves, "saved_tokens": saved, "size": size, "ends_sha256": ends}
        row, n, least = top, n_all, conv
    yield named(p, waiting, None, conv, partial, -1)


def named(p: Paths, nodes: dict, up: np.ndarray | None, conv: np.ndarray, unfinished: np.ndarray, depth: int) -> pa.RecordBatch:
    """Nodes with their parent's name, or its key where the parent is not finished in this task."""
    row, partial = nodes.pop("row").tolist(), nodes["partial"]
    parent: list[bytes | None] = [None] * len(row)
    parent_conv = [None] * len(row)
    if up is not None:
        for k, u in enumerate(up.tolist()):
            if unfinished[u]:
                parent[k] = key_of(p.path[row[k]][:depth * WIDTH])
            else:
                parent_conv[k] = int(conv[u])
    key = [key_of(p.path[r][:(depth + 1) * WIDTH]) if open_ else None for r, open_ in zip(row, partial.tolist(), strict=True)]
    return node_rows(key=key, parent=parent, parent_conv_id=parent_conv, **nodes)


def peel_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p = Paths(batches)
    if p.path:
        yield from peeled(p)


def peel_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that tasks left open: partial sums of one node merged, then peeled from the deepest to the root."""
    nodes: dict[bytes, dict] = {}
    for b in batches:
        for r in b.to_pylist():
            held = nodes.setdefault(r["key"], r)
            if held is not r:
                for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    held[c] += r[c]
                held["conv_id"] = min(held["conv_id"], r["conv_id"])
                if held["ends_sha256"] == NO_ENDS:
                    held["ends_sha256"] = r["ends_sha256"]
    done = sorted(nodes.values(), key=lambda r: -r["depth"])
    for r in done:
        r["n_leaves"] = r["n_leaves"] or 1
        r["saved_tokens"] += (r["n_convs"] - 1) * r["size"]
        if r["parent"] is not None:
            up = nodes[r["parent"]]
            up["n_children"] += 1
            up["n_leaves"] += r["n_leaves"]
            up["saved_tokens"] += r["saved_tokens"]
    for r in done:
        r["parent_conv_id"] = None if r["parent"] is None else nodes[r["parent"]]["conv_id"]
        r["parent"] = None
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=NODE)


def trie(paths: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of (conv_id, path, sizes), one row each."""
    folded = written(distinct_paths(paths), "paths")
    tasks = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = folded.repartitionByRange(tasks, "path").sortWithinPartitions("path", "block").select("path", "n", "conv_id", "ids", "sizes")
    nodes = written(dealt.mapInArrow(peel_paths, NODE_DDL), "nodes")
    top = written(nodes.filter("partial").repartition(1).mapInArrow(peel_open, NODE_DDL), "open")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    waiting = nodes.filter("NOT partial AND parent IS NOT NULL").drop("parent_conv_id")
    names = top.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    return (top.select(*columns).union(nodes.filter("NOT partial AND parent IS NULL").select(*columns))
            .union(hot_join(waiting, names, "parent", "n_children").select(*columns)))


def prefix_trie(conversations: DataFrame, group: int = GROUP) -> DataFrame:
    return trie(rebuilt(conversations, group))
