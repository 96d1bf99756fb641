"""Work on keys that a large part of all rows may share: a join that spreads them, and connected components by it."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erisk.llm.common import written

#: A key is hot if it has more rows than this, and more than its share of all. So there are at most SHARE hot keys.
ROWS, SHARE = 1000, 10_000


def hot_join(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """`left` joined with `right` (one row a key; `weight`: its number of rows in `left`), without `weight`.

    Rows of hot keys meet a broadcast of these keys alone and are not shuffled; the others take Spark's own join. Weights sum
    to the rows of `left`, so at most SHARE keys lie above 1 / SHARE of them: that bounds the broadcast at any size.
    """
    total, top = right.agg(F.sum(weight), F.max(weight)).first()
    limit = max(ROWS, (total or 0) // SHARE)
    if (top or 0) <= limit:
        return left.join(right.drop(weight), key, how)
    hot = F.broadcast(right.filter(F.col(weight) > limit).drop(weight))
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.filter(F.col(weight) <= limit).drop(weight), key, how)
    return cold.unionByName(left.join(hot, key))


def components(edges: DataFrame) -> DataFrame:
    """(c, root) for every end of an edge (u, v): root is the least end that a path leads to.

    Alternating large-star and small-star over written tables until nothing changes. The centre of a star has as many edges
    as its component has members, so each step joins by `hot_join`.
    """
    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("v", "u")).toDF("u", "v") if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w")).select("u", F.least("u", "m").alias("m"), "w"), "least")
        joined = hot_join(both, least, "u", "w")
        if large:
            new = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            new = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m").toDF("u", "v"))
        return written(new.filter("u <> v").distinct(), "stars")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = written(edges.toDF("u", "v").filter("u <> v").distinct(), "stars")
    before = mark(e)
    while before[0]:
        e = step(step(e, True), False)
        after = mark(e)
        if after == before:
            break
        before = after
    return e.toDF("c", "root")
