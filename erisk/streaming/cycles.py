"""Gap-delimited cycles on an event stream (ST2)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def session_cycles(events: DataFrame, key: str, ts: str, failed: Column, event_id: str, gap: str,
                   delay: str | None = None) -> DataFrame:
    """One row per cycle: its first event (fail first at one time, then lowest id), size and fails.

    A session of the gap is exactly a run of events each within the gap of the previous one. On a
    stream (``delay`` given) a row is final once the watermark passes the session's end; state is one
    open session per key. With merging in the local partition on, a hot key ships sessions, not rows.
    """
    source = events if delay is None else events.withWatermark(ts, delay)
    first = F.struct(F.col(ts).alias("ts"), (1 - failed).alias("passed"), F.col(event_id).alias("id"))
    return (source.groupBy(F.col(key), F.session_window(ts, gap).alias("w"))
            .agg(F.min(first).alias("first"), F.count("*").alias("n_events"), F.sum(failed).alias("n_failed"),
                 F.max(ts).alias("last_ts"))
            .select(key, F.col("first.id").alias("event_id"), F.col("first.ts").alias("first_ts"),
                    (1 - F.col("first.passed")).alias("failed"), "n_events", "n_failed", "last_ts"))


def batch_cycles(events: DataFrame, key: str, ts: str, failed: Column, event_id: str, gap_seconds: int) -> DataFrame:
    """The batch twin over a finished table: the same rows, every session closed.

    Events in one time block as long as the gap always belong together, so they are first folded to
    one row per (key, block) with a map-side combine; a hot key then has at most span / gap rows.
    """
    first = F.struct(F.col(ts).alias("ts"), (1 - failed).alias("passed"), F.col(event_id).alias("id"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    block = F.floor(micros(ts) / F.lit(gap_seconds * 1_000_000))
    folded = events.groupBy(key, block.alias("__block")).agg(
        F.min(first).alias("first"), F.count("*").alias("n_events"), F.sum(failed).alias("n_failed"),
        F.max(ts).alias("last_ts"))
    w = Window.partitionBy(key).orderBy("__block")
    timed = folded.withColumn("__from", micros("first.ts")).withColumn("__to", micros("last_ts"))
    wait = F.col("__from") - F.lag("__to").over(w)
    starts = timed.withColumn("__new", F.coalesce((wait > gap_seconds * 1_000_000).cast("int"), F.lit(1)))
    numbered = starts.withColumn("__session", F.sum("__new").over(w))
    return (numbered.groupBy(key, "__session").agg(
        F.min("first").alias("first"), F.sum("n_events").alias("n_events"), F.sum("n_failed").alias("n_failed"),
        F.max("last_ts").alias("last_ts"))
        .select(key, F.col("first.id").alias("event_id"), F.col("first.ts").alias("first_ts"),
                (1 - F.col("first.passed")).alias("failed"), "n_events", "n_failed", "last_ts"))
