"""Deterministic samples: ordered pools without shared entities, and simple ones."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from erisk.functions.rules import any_of
from erisk.session import durable


def hash_order(seed: int, *keys) -> Column:
    """A seeded order that any engine can repeat: md5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def first_in_order(df: DataFrame, order: str, tie: str, n: int) -> DataFrame:
    """The first n rows by (md5 in ``order``, ``tie``). Blocks of the md5 are counted; only the block in which the n-th row lies
    is ordered, so neither a task nor the driver holds the n rows."""
    block = F.substring(order, 1, 4)                                                    # 65,536 blocks at most
    upto = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(block.alias("__block")).agg(F.count("*").alias("__size"))
    before = F.broadcast(sizes.select("__block", "__size", F.coalesce(F.sum("__size").over(upto), F.lit(0)).alias("__before")).where(F.col("__before") < n))
    near = df.withColumn("__block", block).join(before, "__block")
    whole = near.where(F.col("__before") + F.col("__size") <= n)
    last = near.where(F.col("__before") + F.col("__size") > n)                          # one block
    place = F.row_number().over(Window.partitionBy("__block").orderBy(order, tie))
    cut = last.withColumn("__place", place + F.col("__before")).where(F.col("__place") <= n)
    return whole.select(*df.columns).unionByName(cut.select(*df.columns))


def sample_pools(df: DataFrame, pools: dict, sizes: dict, entity: str, row_key: str, seed: int = 42) -> DataFrame:
    """``sizes[pool]`` rows per pool in pool order, one row per entity, no entity in two pools.

    ``pools`` maps a pool to its predicate. Each pool is one round: its entities less those already taken (an anti join),
    one row each, and the first of them in hash order. Rounds pass tables on, whatever the sizes.
    """
    names = list(pools)
    matching = F.array_compact(F.array(*[F.when(pools[n], F.lit(n)) for n in names]))
    rows = (df.where(any_of([F.coalesce(pools[n], F.lit(False)) for n in names]))
            .withColumn("__h", hash_order(seed, row_key)).withColumn("pool", F.explode(matching)))
    one = durable(rows.groupBy("pool", entity).agg(F.min(F.struct("__h", F.col(row_key).alias("__k"))).alias("m"))
                  .select("pool", entity, "m.__h", "m.__k"))
    used = picked = None
    for n in names:
        left = one.where(F.col("pool") == n)
        if used is not None:
            left = left.join(used, entity, "left_anti")
        taken = durable(first_in_order(left, "__h", "__k", sizes[n]))
        used = taken.select(entity) if used is None else used.union(taken.select(entity))
        picked = taken if picked is None else picked.unionByName(taken)
    return df.join(picked.select("pool", F.col("__k").alias(row_key)), row_key)


def simple_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """N rows in hash order, without replacement."""
    return df.orderBy(hash_order(seed, key), key).limit(n)
