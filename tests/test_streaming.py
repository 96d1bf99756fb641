import datetime as dt
import random

from pyspark.sql import functions as F

from erisk.streaming import cycles as C, jobs

SCHEMA = "event_id bigint, user_id string, ts timestamp, bad int"


def data(seed=1, n=1200):
    """A third of all events on one key."""
    rng = random.Random(seed)
    at = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        key = "HOT" if rng.random() < 1 / 3 else f"u{rng.randrange(12)}"
        rows.append((i, key, at + dt.timedelta(seconds=rng.randrange(40 * 86400)), rng.randrange(2)))
    return sorted(rows, key=lambda r: r[2])


def brute(rows, gap):
    out = {}
    for i, key, ts, bad in sorted(rows, key=lambda r: (r[1], r[2], -r[3], r[0])):
        sessions = out.setdefault(key, [])
        if not sessions or ts - sessions[-1]["last"] > gap:
            sessions.append({"id": i, "first": ts, "failed": bad, "n": 0, "bad": 0, "last": ts})
        s = sessions[-1]
        s["n"], s["bad"], s["last"] = s["n"] + 1, s["bad"] + bad, ts
    return {(k, s["id"], s["first"], s["failed"], s["n"], s["bad"], s["last"]) for k, ss in out.items() for s in ss}


def as_set(df):
    return {(r["user_id"], r["event_id"], r["first_ts"], r["failed"], r["n_events"], r["n_failed"], r["last_ts"]) for r in df.collect()}


def test_batch_forms_agree(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, dt.timedelta(hours=12))
    assert as_set(C.batch_cycles(df, "user_id", "ts", F.col("bad"), "event_id", 12 * 3600)) == want
    assert as_set(C.session_cycles(df, "user_id", "ts", F.col("bad"), "event_id", "12 hours")) == want


def test_gap_edge(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "a", t, 0), (2, "a", t + dt.timedelta(hours=12), 1), (3, "b", t, 0), (4, "b", t + dt.timedelta(hours=12, seconds=1), 1),
            (5, "c", t, 0), (6, "c", t, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for out in (C.batch_cycles(df, "user_id", "ts", F.col("bad"), "event_id", 12 * 3600),
                C.session_cycles(df, "user_id", "ts", F.col("bad"), "event_id", "12 hours")):
        got = {(r["user_id"], r["event_id"], r["n_events"]) for r in out.collect()}
        assert got == {("a", 1, 2), ("b", 3, 1), ("b", 4, 1), ("c", 6, 2)}     # exactly the gap stays together; fail first


def test_stream_in_several_files(spark, tmp_path):
    rows = data(2)
    folder = tmp_path / "in"
    for k in range(4):
        part = spark.createDataFrame(rows[k * 300:(k + 1) * 300], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    # the delay covers any order in which the files arrive, so no event is late
    cycles = C.session_cycles(stream, "user_id", "ts", F.col("bad"), "event_id", "12 hours", "60 days")
    jobs.run_available(cycles, str(tmp_path / "out"), str(tmp_path / "check"))
    # one far later event per key moves the watermark past every session
    flush = [(9000 + i, f"flush{i}", dt.datetime(2024, 12, 1) + dt.timedelta(days=i), 0) for i in range(2)]
    spark.createDataFrame(flush, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    jobs.run_available(cycles, str(tmp_path / "out"), str(tmp_path / "check"))     # resumes from the checkpoint
    out = spark.read.schema(cycles.schema).parquet(str(tmp_path / "out")).where("user_id NOT LIKE 'flush%'")
    assert as_set(out) == brute(rows, dt.timedelta(hours=12))
    assert out.count() == len(as_set(out))                                        # each cycle exactly once
