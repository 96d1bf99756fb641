"""What several operators share: written tables, batch sizes, key expressions and the held-out fold."""
from __future__ import annotations

import functools
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from erisk.session import shared_folder

#: Rows in one Arrow batch of a Python stage. Spark also ends a batch at 64 MB, so very long texts come in short batches.
BATCH_ROWS = 2000


def prepare(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what a Python worker holds at once, and give executors this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    sc, name = spark.sparkContext, "erisk_package.zip"
    if name in sc._python_includes:
        return
    package = pathlib.Path(__file__).resolve().parents[1]
    path = f"{tempfile.mkdtemp(prefix='erisk-package-')}/{name}"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the folder that all executors share: computed once, its lineage cut, safe from lost executors."""
    folder = shared_folder(df.sparkSession, f"llm-{name}-{uuid.uuid4().hex[:8]}")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: Column) -> Column:
    """crc32 of the key as text, mod 3, is 1; a null key is in no held-out fold."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, once per Python worker; special tokens' strings in a text are ordinary text."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok
