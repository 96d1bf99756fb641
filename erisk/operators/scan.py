"""Ordered totals over a whole column without a single-task window.

Rank-like results (AUC, ROC, quantiles, peer ranks) need running totals in value order. A plain
window would put one group, or the whole table, into one task. Here rows are first aggregated to
one cell per distinct value (map-side combine, hashed on the full key, so a hot value costs one
row per task), cells get a coarse, order-keeping block number, running totals are taken inside
(group, block), and the short list of block totals gives each block its starting offset.
"""
from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

UNIT_BLOCKS = 16384   # per level; powers of two multiply exactly, so blocks keep the order
LEVEL_BITS, LEVELS = 7, 5
BLOCK = "__block"


def unit_block(value: Column) -> Column:
    """An order-keeping block number for scores in [0, 1], finer for smaller ones.

    A score in [2^-7(k+1), 2^-7k) is cut to blocks of width 2^-(14+7k), so models that give every
    row a tiny probability still spread over thousands of blocks.
    """
    level = lambda k: (F.floor(value * F.lit(float(UNIT_BLOCKS * 2 ** (LEVEL_BITS * k)))) - k * UNIT_BLOCKS).cast("long")
    out = F.when(value >= 2.0 ** -LEVEL_BITS, level(0))
    for k in range(1, LEVELS - 1):
        out = out.when(value >= 2.0 ** (-LEVEL_BITS * (k + 1)), level(k))
    return out.otherwise(level(LEVELS - 1))


def value_bounds(df: DataFrame, columns, n_blocks: int | None = None) -> dict[str, list[float]]:
    """Approximate quantiles per column, used only to balance blocks; results never depend on them.

    There are a few blocks for each shuffle partition the session is set up for, so they grow with the cluster.
    """
    n_blocks = n_blocks or max(200, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probs = [i / n_blocks for i in range(1, n_blocks)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, max(2000, 10 * n_blocks)).alias(c) for c in columns]).first()
    return {c: sorted(set(row[c] or [])) for c in columns}


def block_of(df: DataFrame, value: str, bounds=None, out: str = BLOCK) -> DataFrame:
    """Add an order-keeping block number: fixed for [0, 1], or binary search in given bounds."""
    if bounds is None:
        return df.withColumn(out, unit_block(F.col(value)))
    if not bounds:
        return df.withColumn(out, F.lit(0).cast("long"))
    splits = [float("-inf"), *bounds, float("inf")]
    return (Bucketizer(splits=splits, inputCol=value, outputCol=out).transform(df)
            .withColumn(out, F.col(out).cast("long")))


def cells(df: DataFrame, groups, value: str, sums: dict[str, Column], bounds=None) -> DataFrame:
    """One row per (group, value) with the given totals and its block; NULL values are left out."""
    grouped = (df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias(value))
                 .agg(*[F.sum(c).alias(k) for k, c in sums.items()]))
    return block_of(grouped, value, bounds)


def join_same(left: DataFrame, right: DataFrame, keys, how="inner") -> DataFrame:
    """Equi-join on keys where NULL equals NULL; keeps one copy of the keys."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def block_offsets(cell_df: DataFrame, groups, names) -> DataFrame:
    """(group, block) -> totals before the block and of the whole group; a few thousand rows a group."""
    per_block = cell_df.groupBy(*groups, BLOCK).agg(*[F.sum(n).alias(f"__t_{n}") for n in names])
    before = Window.partitionBy(*groups).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    return per_block.select(
        *groups, BLOCK,
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__off_{n}") for n in names],
        *[F.sum(f"__t_{n}").over(whole).alias(f"total_{n}") for n in names],
        *[F.col(f"__t_{n}") for n in names])


def running(cell_df: DataFrame, groups, value: str, names) -> DataFrame:
    """Cells with before_<name> (total of smaller values) and total_<name> (group total)."""
    inside = (Window.partitionBy(*groups, BLOCK).orderBy(value)
                    .rowsBetween(Window.unboundedPreceding, -1))
    local = cell_df.select("*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"__in_{n}") for n in names])
    offsets = block_offsets(cell_df, groups, names).drop(*[f"__t_{n}" for n in names])
    out = join_same(local, offsets, [*groups, BLOCK])
    for n in names:
        out = out.withColumn(f"before_{n}", F.col(f"__in_{n}") + F.col(f"__off_{n}"))
    return out.drop(BLOCK, *[f"__in_{n}" for n in names], *[f"__off_{n}" for n in names])


def quantiles(df: DataFrame, value: str, probs, groups=(), bounds=None, weight: Column | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles, long form: (group, prob, quantile, n).

    ``weight`` counts identical rows, for input that is already aggregated.
    """
    groups = list(groups)
    cell_df = cells(df, groups, value, {"n": weight if weight is not None else F.lit(1)}, bounds)
    inside = Window.partitionBy(*groups, BLOCK).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = cell_df.withColumn("__in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    blocks = block_offsets(cell_df, groups, ["n"])
    position = lambda q: (F.col("total_n") - 1) * F.lit(float(q))
    targets = F.array(*[
        F.struct(F.lit(float(q)).alias("prob"), F.lit(side).alias("side"), index.alias("index"),
                 (position(q) - F.floor(position(q))).alias("part"))
        for q in probs for side, index in (("low", F.floor(position(q))), ("high", F.ceil(position(q))))])
    wanted = (blocks.withColumn("__all", targets)
              .select(*groups, BLOCK, "__off_n", "total_n",
                      F.explode(F.filter("__all", lambda t: (t["index"] >= F.col("__off_n"))
                                         & (t["index"] < F.col("__off_n") + F.col("__t_n")))).alias("t"))
              .select(*groups, BLOCK, F.col("total_n"), "t.prob", "t.side", "t.part",
                      (F.col("t.index") - F.col("__off_n")).alias("__index")))
    hit = join_same(local.select(*groups, BLOCK, value, "n", "__in"), wanted, [*groups, BLOCK]) \
        .where((F.col("__index") >= F.col("__in")) & (F.col("__index") < F.col("__in") + F.col("n")))
    low = F.max(F.when(F.col("side") == "low", F.col(value)))
    high = F.max(F.when(F.col("side") == "high", F.col(value)))
    return (hit.groupBy(*groups, "prob", F.col("total_n"))
               .agg(low.alias("__low"), high.alias("__high"), F.max("part").alias("__part"))
               .select(*groups, "prob",
                       (F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("__part")).alias("quantile"),
                       F.col("total_n").alias("n")))
