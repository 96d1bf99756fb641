"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

At each level the children of the chosen node draw -ln(u) / weight, u hashed from the key and the child's name, and the
least draw wins; a node weighs the sum of its shards. A changed weight changes that node's draw alone at its level, so keys
move only into or out of subtrees whose weights change. A new shard that is a region of its own takes keys only into itself.

Column expressions only, no join and no Python: the law is `key` (doc_id and the tree decide). Slots number the rows of a
shard without gaps: rows are ordered by a hash, cut into hash ranges of some 4,000 rows that are numbered one by one, and
the counts of earlier ranges are added. Texts are read once, for size and checksum, and not shuffled.

Defined results: a null key is a key like any other; null texts have size 1 and the checksum of nothing; repeated rows get
slots of their own. Only doc_id and text are read.
"""
from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erisk.llm.common import written

#: Hash values have 52 bits, 13 hexadecimal digits of an MD5.
BITS, RANGE_ROWS = 52, 4096


@dataclass(frozen=True)
class Shard:
    shard: int
    region: str
    rack: str
    weight: float = 1.0


#: 16 equal shards: four regions of two racks of two shards; the grown tree adds one region with shard 16.
TREE = [Shard(k, f"region{k // 4}", f"rack{k // 2}") for k in range(16)]
GROWN = [*TREE, Shard(16, "region4", "rack8")]


def hashed(*parts: Column | str) -> Column:
    text = F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")


def draw(key: Column, name: str, weight: float) -> Column:
    return -F.log((hashed(name, key) + 0.5) / float(1 << BITS)) / weight


def winner(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the least draw (name, weight, value)."""
    if len(children) == 1:
        return children[0][2]
    draws = F.array(*(draw(key, n, w) for n, w, _ in children))
    at = F.array_position(draws, F.array_min(draws))
    chosen = F.when(at == 1, children[0][2])
    for k, (_, _, value) in enumerate(children[1:], 2):
        chosen = chosen.when(at == k, value)
    return chosen


def descend(key: Column, tree: list[Shard]) -> Column:
    """The shard of a key; below a node only the branch that won is evaluated."""
    live = sorted((s for s in tree if s.weight > 0), key=lambda s: (s.region, s.rack, s.shard))
    regions = []
    for region, members in groupby(live, lambda s: s.region):
        racks = []
        for rack, own in groupby(list(members), lambda s: s.rack):
            own = list(own)
            leaf = winner(key, [(f"{region}/{rack}/{s.shard}", s.weight, F.lit(s.shard)) for s in own])
            racks.append((f"{region}/{rack}", sum(s.weight for s in own), leaf))
        regions.append((region, sum(w for _, w, _ in racks), winner(key, racks)))
    return winner(key, regions)


def sharded(documents: DataFrame, tree: list[Shard] | None = None, grown: list[Shard] | None = None,
            range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (its shard in the grown tree) of every document."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = documents.select("doc_id", (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.withColumns({"shard": descend(key, tree or TREE), "grown_shard": descend(key, grown or GROWN),
                             "h": hashed("slot", key, F.col("text_crc32").cast("string"), F.col("size").cast("string"))})
    rows = written(rows, "shards")
    shards = len({s.shard for s in tree or TREE})
    bits = max(0, (max(1, rows.count()) // (shards * range_rows)).bit_length())
    rows = rows.withColumn("part", F.shiftright("h", BITS - bits))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    order = Window.partitionBy("shard", "part").orderBy("h", "doc_id", "text_crc32", "size")
    inside = rows.withColumn("at", F.row_number().over(order) - 1)
    return inside.join(before, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("at")).alias("slot"), "grown_shard")
