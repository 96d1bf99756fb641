"""Session settings the operators are designed for, and the one way we cut lineage."""
from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # no call site per column: plans of many columns are built in half the time
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # merge gap sessions before the shuffle, so a hot key ships sessions, not rows
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in CONF.items():
        builder = builder.config(key, value)
    return builder


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names; survives lost executors.

    Used where one table feeds several jobs (fit, calibrate, validate), so it is computed once.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="erisk-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside go when each has ended; else they stay until the driver happens to collect its
    garbage, and the disk holds those of all steps at once. For actions whose result is in files."""
    before = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (local temporary folder in tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        return tempfile.mkdtemp(prefix=f"erisk-{name}-")
    import uuid
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application; functions that run in Python workers need it."""
    import pathlib
    import zipfile

    if spark.sparkContext.applicationId in SHIPPED:
        return
    package = pathlib.Path(__file__).resolve().parent
    path = f"{tempfile.mkdtemp(prefix='erisk-code-')}/erisk_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)
    SHIPPED.add(spark.sparkContext.applicationId)


SHIPPED: set[str] = set()
