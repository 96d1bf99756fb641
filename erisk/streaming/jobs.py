"""Running a stream to the end of its input, into files (ST1, ST2)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from erisk.operators.nested import score_records, without_texts
from erisk.session import durable, freed_shuffles, shared_folder
from erisk.settings import Settings


def run_available(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Process what is there, append files exactly once, stop. Restarting resumes from the checkpoint."""
    query = (stream.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start(path))
    query.awaitTermination()


def score_stream(records: DataFrame, model: dict, s: Settings, today: Column) -> DataFrame:
    """ST1 for whole documents: the batch record scorer on a stream, narrow and stateless. Documents in parts are left
    to ``score_to_table``."""
    whole = records.where(F.coalesce("n_parts", F.lit(1)) == 1).drop("part", "n_parts")
    return score_records(whole, model, s, today)


ARRIVAL = "registration string, part bigint, n_parts bigint, batch bigint, arrived timestamp"
SETTLED = "registration string, complete boolean, n_seen bigint, n_parts bigint, batches array<bigint>, parts array<bigint>"
WAITING = ("registration", "part", "n_parts", "batch", "at", "deadline")
BUCKETS = 1024     # Python calls a micro-batch at most, whatever the number of entities; fixed, as state is kept by it


def settle_parts(arrivals: DataFrame, limit_seconds: int) -> DataFrame:
    """Keyed state of the parts of each entity: a row when all have arrived, or when some are missing ``limit_seconds`` after
    the last of them came.

    The state holds numbers only, which parts of unfinished entities came and the batches they lie in; the parts themselves
    never meet in a task. A state is that of a hash bucket of entities, so a call settles many at once. Time is the watermark
    of arrivals, so the limit counts from what the stream has seen, not from the clock of a machine.
    """
    def settle(key, chunks, state):
        import pandas as pd

        now = state.getCurrentWatermarkMs()
        held = pd.DataFrame(dict(zip(WAITING, state.get, strict=True)) if state.exists else {c: [] for c in WAITING})
        fresh = [] if state.hasTimedOut else [c[list(WAITING[:-1])].assign(deadline=-1) for c in chunks]
        rows = pd.concat([x for x in (held, *fresh) if len(x)]).reset_index(drop=True)
        entity = rows.groupby("registration", dropna=False, sort=False)
        is_fresh = entity["deadline"].transform("min") < 0
        latest = entity["at"].transform("max") + 1000 * limit_seconds
        rows["deadline"] = rows["deadline"].where(~is_fresh, latest.clip(lower=now + 1)).astype("int64")
        n_parts, n_seen = entity["n_parts"].transform("max"), entity["part"].transform("nunique")
        complete = n_seen >= n_parts
        done = complete | (rows["deadline"] < now)
        if done.any():
            found = {}
            for name, full, seen, n, b, p in zip(*(x[done] for x in (rows["registration"], complete, n_seen, n_parts, rows["batch"], rows["part"])), strict=True):
                name = None if pd.isna(name) else name
                found.setdefault(name, (name, full, seen, n, set(), set()))
                found[name][4].add(int(b))
                found[name][5].add(int(p))
            yield pd.DataFrame([(*x[:4], sorted(x[4]), sorted(x[5])) for x in found.values()],
                               columns=["registration", "complete", "n_seen", "n_parts", "batches", "parts"])
        left = rows[~done]
        if len(left):
            state.update(tuple([None if pd.isna(v) else v if c == "registration" else int(v) for v in left[c]] for c in WAITING))
            state.setTimeoutTimestamp(int(left["deadline"].min()))
        elif state.exists:
            state.remove()

    bucket = F.pmod(F.xxhash64("registration"), F.lit(BUCKETS))
    waiting = "registration array<string>, " + ", ".join(f"{c} array<bigint>" for c in WAITING[1:])
    dealt = arrivals.withWatermark("arrived", "0 seconds").withColumn("at", F.unix_millis("arrived")).withColumn("bucket", bucket)
    return dealt.groupBy("bucket").applyInPandasWithState(settle, SETTLED, waiting, "append", "EventTimeTimeout")


def score_to_table(spark: SparkSession, records: DataFrame, model: dict, s: Settings, today: Column, folder: str,
                   limit_seconds: int = 86_400, arrived: Column | None = None) -> DataFrame:
    """ST1 for all documents of a stream: ``records`` to scores under ``folder``, read back.

    Whole documents are scored in the micro-batch they come in. Parts of an entity may arrive in different batches: they are
    written once, to the folder of their batch, and never moved. A second stream over their numbers keeps the state of each
    entity (``settle_parts``); an entity that is complete has its parts read from just the batches they lie in, and the
    batch scorer splits them over tasks. Entities with a part missing after ``limit_seconds`` are reported by ``lost_parts``.
    Outputs of a batch are overwritten when it is repeated, so a restart gives each score once.
    """
    schema, types = records.schema, dict(records.dtypes)
    parts_of, arrivals, out, lost = (f"{folder}/{x}" for x in ("parts", "arrivals", "out", "lost"))
    several = F.coalesce("n_parts", F.lit(1)) > 1

    def take(df: DataFrame, number: int) -> None:
        score_records(df.where(~several), model, s, today).write.mode("overwrite").parquet(f"{out}/whole/batch={number}")
        at = F.current_timestamp() if arrived is None else arrived
        df.where(several).withColumn("__arrived", at).write.mode("overwrite").option("compression", "zstd").parquet(f"{parts_of}/batch={number}")
        parts = df.sparkSession.read.schema(f"registration string, part {types['part']}, n_parts {types['n_parts']}, __arrived timestamp") \
            .parquet(f"{parts_of}/batch={number}")
        parts.select("registration", F.col("part").cast("bigint"), F.col("n_parts").cast("bigint"), F.lit(number).cast("bigint").alias("batch"),
                     F.col("__arrived").alias("arrived")).write.mode("overwrite").parquet(f"{arrivals}/{number}")

    def settle(df: DataFrame, number: int) -> None:
        session, df = df.sparkSession, durable(df)
        df.where("NOT complete").select("registration", "n_seen", "n_parts").write.mode("overwrite").parquet(f"{lost}/batch={number}")
        ready = df.where("complete")
        numbers = sorted({b for r in ready.select(F.explode("batches").alias("b")).distinct().collect() for b in r})   # micro-batches
        if not numbers:
            return
        every = without_texts(session.read.schema(schema).parquet(*[f"{parts_of}/batch={b}" for b in numbers]))
        keys = ready.select("registration", F.explode("parts").alias("part")).withColumn("part", F.col("part").cast(types["part"]))
        own = every.join(keys, ["registration", "part"], "left_semi").dropDuplicates(["registration", "part"])
        with freed_shuffles(session):
            score_records(own, model, s, today).write.mode("overwrite").parquet(f"{out}/parts/batch={number}")

    def run(stream: DataFrame, step, name: str) -> None:
        stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint-{name}") \
            .trigger(availableNow=True).start().awaitTermination()

    run(records, take, "records")
    arrived_parts = spark.readStream.schema(ARRIVAL).option("recursiveFileLookup", "true").parquet(arrivals)
    run(settle_parts(arrived_parts, limit_seconds), settle, "parts")
    return spark.read.option("recursiveFileLookup", "true").parquet(out)


def lost_parts(spark: SparkSession, folder: str) -> DataFrame:
    """registration, n_seen and n_parts of entities of which a part did not come within the limit."""
    return spark.read.schema("registration string, n_seen bigint, n_parts bigint").option("recursiveFileLookup", "true").parquet(f"{folder}/lost")


def run_to_table(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run and read back what was written; the schema is the stream's own."""
    folder = shared_folder(spark, name)
    run_available(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
