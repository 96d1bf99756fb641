"""Bootstrap intervals and permutation importance (A24, A39), by one rule at every size.

Bootstrap: a row's weight in a replicate is Poisson(1), read off an md5 of seed and key, so a lost task draws it again and no
draw is ever stored or moved: given its total, such a resample is a multinomial one. Rows move once, ordered by score, in one
form: (score, value, outcome, key). Each task draws all replicates of its rows as one matrix and sums wins of pairs in one
sorted pass; a value that many rows share may lie in several tasks, whose half wins are settled when the few totals meet.

Permutation: rows are ranked by md5 of the key (a rank inside a block, plus the block's offset), and a keyed bijection of ranks
sends each row to its donor: a Feistel network on a x b >= n places, walked on from the few places beyond n. So every repeat
is a permutation of the whole table at any size, found by one equi-join on ranks, which no two rows share.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from erisk.operators.metrics import auc
from erisk.session import durable, ship_package

# Cumulative Poisson(1) probabilities for 0, 1, 2, ...
POISSON_ONE = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(12)]


# ---- bootstrap ------------------------------------------------------------------

def weights(keys: list[str], reps: int, seed: int) -> np.ndarray:
    """Poisson(1) weights, (row, replicate): four replicates from each md5 of "seed|quarter|key"."""
    quarters = -(-reps // 4)
    digests = b"".join(hashlib.md5(f"{seed}|{q}|{k}".encode()).digest() for k in keys for q in range(quarters))
    u = (np.frombuffer(digests, ">u4").reshape(len(keys), 4 * quarters)[:, :reps] + 0.5) / 2.0 ** 32
    return np.searchsorted(POISSON_ONE, u, "right").astype(np.float64)


TOTALS = ["win", "pos", "neg", "first_pos", "first_neg", "last_pos", "last_neg"]
PARTS = "score string, first double, last double, " + ", ".join(f"{c} array<double>" for c in TOTALS)


class Pass:
    """Running totals of one score over the sorted rows of a task; the value seen last stays open for more rows."""

    def __init__(self, score: str, reps: int):
        self.score, self.value, self.first = score, None, None
        self.win, self.pos, self.neg, self.open = np.zeros(reps), np.zeros(reps), np.zeros(reps), np.zeros((2, reps))

    def add(self, value: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        start = np.flatnonzero(np.append(True, np.diff(value) != 0))
        pos, neg = (np.add.reduceat(w * t[:, None], start) for t in (y, 1 - y))
        if self.value is not None:
            if value[0] == self.value:
                pos[0] += self.open[0]
                neg[0] += self.open[1]
            else:
                self.close(self.value, self.open[:1], self.open[1:])
        self.value, self.open = float(value[-1]), np.array([pos[-1], neg[-1]])
        if len(start) > 1:
            self.close(float(value[0]), pos[:-1], neg[:-1])

    def close(self, value: float, pos: np.ndarray, neg: np.ndarray) -> None:
        if self.first is None:
            self.first = (value, pos[0], neg[0])
        below = self.neg + np.cumsum(neg, axis=0) - neg
        self.win += (pos * (below + 0.5 * neg)).sum(axis=0)
        self.pos += pos.sum(axis=0)
        self.neg += neg.sum(axis=0)

    def row(self) -> dict:
        last, last_pos, last_neg = self.value, *self.open
        self.close(self.value, self.open[:1], self.open[1:])
        vectors = (self.win, self.pos, self.neg, self.first[1], self.first[2], last_pos, last_neg)
        return {"score": self.score, "first": self.first[0], "last": last, **{c: v.tolist() for c, v in zip(TOTALS, vectors, strict=True)}}


def sorted_pass(reps: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: Pass | None = None
        done: list[dict] = []
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000).to_pandas()
                for score, rows in part.groupby("score", sort=False):
                    if open_ is None or open_.score != score:
                        if open_ is not None:
                            done.append(open_.row())
                        open_ = Pass(score, reps)
                    open_.add(rows["value"].to_numpy(), rows["y"].to_numpy(), weights(rows["key"].tolist(), reps, seed))
        if open_ is not None:
            done.append(open_.row())
        yield from pa.Table.from_pandas(pd.DataFrame(done, columns=["score", "first", "last", *TOTALS]), preserve_index=False).to_batches() if done else ()
    return run


def settled(parts: pd.DataFrame) -> pd.DataFrame:
    """AUC of each replicate from the totals of all tasks of one score."""
    parts = parts.sort_values(["first", "last"])
    win = pos = neg = tie_pos = tie_neg = 0.0
    tie = None
    for r in parts.itertuples():
        own = {c: np.array(getattr(r, c)) for c in TOTALS}
        win = win + own["win"] + own["pos"] * neg
        if r.first == tie:       # equal values in earlier tasks: pairs with them are half wins
            win = win + 0.5 * (tie_pos * own["first_neg"] - tie_neg * own["first_pos"])
        keep = r.last == tie
        tie, tie_pos, tie_neg = r.last, own["last_pos"] + (tie_pos if keep else 0), own["last_neg"] + (tie_neg if keep else 0)
        pos, neg = pos + own["pos"], neg + own["neg"]
    with np.errstate(invalid="ignore", divide="ignore"):
        value = np.where(pos * neg > 0, win / (pos * neg), np.nan)
    return pd.DataFrame({"score": parts["score"].iloc[0], "rep": np.arange(1, len(value) + 1), "auc": value})


def bootstrap_auc(df: DataFrame, key: str, label: str, scores, reps: int = 200, seed: int = 0) -> DataFrame:
    """Several scores on the same resamples: (score, rep, auc). A replicate with one outcome only has a NULL auc."""
    scores = list(scores)
    ship_package(df.sparkSession)
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in scores)
    long = (df.where(F.col(label).isNotNull())
            .select(F.expr(f"stack({len(scores)}, {pairs}) AS (score, value)"), F.col(label).cast("double").alias("y"),
                    F.col(key).cast("string").alias("key")).where("value IS NOT NULL"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the key cuts a value that a large part of the rows share
    dealt = long.repartitionByRange(tasks, "score", "value", "key").sortWithinPartitions("score", "value")
    parts = dealt.mapInArrow(sorted_pass(reps, seed), PARTS)
    return parts.groupBy("score").applyInPandas(settled, "score string, rep int, auc double").withColumn("auc", F.nanvl("auc", F.lit(None).cast("double")))


def bootstrap_interval(reps: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval per score over the replicates (a few hundred rows a score)."""
    return reps.groupBy("score").agg(
        F.avg("auc").alias("mean_auc"), F.percentile("auc", F.lit(low)).alias("low"),
        F.percentile("auc", F.lit(high)).alias("high"), F.count("*").alias("reps"))


# ---- permutation ----------------------------------------------------------------

def ranked(df: DataFrame, key: str, out: str = "__rank") -> DataFrame:
    """Adds a rank from 0 in the order of md5 of the key; a window holds one of 65,536 blocks only."""
    text = F.col(key).cast("string")
    blocked = df.withColumn("__md5", F.md5(text)).withColumn("__block", F.substring("__md5", 1, 4))
    sizes = blocked.groupBy("__block").agg(F.count("*").alias("n"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)      # 65,536 rows at most
    offsets = sizes.select("__block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__block").orderBy("__md5", text)) - 1
    return blocked.withColumn("__inside", inside).join(F.broadcast(offsets), "__block").withColumn(
        out, F.col("__inside") + F.col("__before")).drop("__md5", "__block", "__inside", "__before")


def feistel(place: Column, n: int, *keys: Column, rounds: int = 4) -> Column:
    """A bijection of 0 .. n - 1 for each value of the keys."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def bound(value: Column, use) -> Column:      # a value named once, so that no use computes it again
        return F.transform(F.array(value), use)[0]

    def half(k: int):
        def run(s: Column) -> Column:
            x, y = s["x"], s["y"]
            word = F.md5(F.concat_ws("|", *[c.cast("string") for c in keys], F.lit(str(k)), (x if k % 2 else y).cast("string")))
            step = F.conv(F.substring(word, 1, 12), 16, 10).cast("bigint")
            return F.struct(*([x.alias("x"), ((y + step) % b).alias("y")] if k % 2 else [((x + step) % a).alias("x"), y.alias("y")]))
        return run

    def once(p: Column) -> Column:
        state = F.struct(F.floor(p / b).alias("x"), (p % b).alias("y"))
        for k in range(rounds):
            state = bound(state, half(k))
        return bound(state, lambda s: s["x"] * b + s["y"])

    # the first step always, then on while beyond n: fewer than a + b of the a * b places are
    walk = lambda p: F.aggregate(F.sequence(F.lit(1), F.lit(64)), p, lambda q, _: F.when(q < n, q).otherwise(once(q)))
    return bound(once(place.cast("bigint")), lambda p: F.when(p < n, p).otherwise(walk(p)))


def permute_columns(df: DataFrame, key: str, columns, repeats: int, seed: int = 0) -> DataFrame:
    """Pair every row with another row, by one permutation of all rows a repeat: adds ``rep`` and ``perm_<column>``."""
    rows = durable(ranked(df, key))
    n = rows.count()
    takers = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats)))) \
        .withColumn("__rank", feistel(F.col("__rank"), n, F.lit(seed), F.col("rep")))
    donors = rows.select("__rank", *[F.col(c).alias(f"perm_{c}") for c in columns])
    return takers.join(donors, "__rank").drop("__rank")


def permutation_importance(df: DataFrame, key: str, label: str, columns, score, repeats: int = 5,
                           seed: int = 0) -> DataFrame:
    """Mean drop of AUC when one column is shuffled.

    ``score(df) -> df`` adds the column ``score``; it sees rows with the same columns as ``df``, one
    per (row, repeat, shuffled feature), so any column expression or fitted model will do.
    """
    columns = list(columns)
    base = auc(score(df), label, "score").select("auc").scalar()
    paired = permute_columns(df, key, columns, repeats, seed)
    variants = F.array(*[
        F.struct(F.lit(f).alias("feature"),
                 *[F.col(f"perm_{c}" if c == f else c).alias(c) for c in columns]) for f in columns])
    long = (paired.select("rep", label, F.explode(variants).alias("x"))
            .select("rep", label, "x.feature", *[F.col(f"x.{c}").alias(c) for c in columns]))
    each = auc(score(long), label, "score", ["feature", "rep"]).withColumn("drop", base - F.col("auc"))
    return each.groupBy("feature").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("spread"))
