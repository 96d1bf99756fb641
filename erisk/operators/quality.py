"""Checks that fail loudly, as tables first."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, functions as F


class CheckFailed(AssertionError):
    pass


class EmptyTable(CheckFailed):
    pass


def require_columns(df: DataFrame, columns) -> DataFrame:
    """Before any job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise CheckFailed(f"columns not in the table: {missing}")
    return df


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    """X1."""
    if df.isEmpty():
        raise EmptyTable(f"no rows in {what}: check the source and the filters")
    return df


def counted(df: DataFrame, what: str, write: Callable[[DataFrame], None]) -> int:
    """X1 for writers: rows are counted as they are written, in the same pass; an empty result is an error."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    if not seen.get["rows"]:
        raise EmptyTable(f"no rows in {what}: check the source and the filters")
    return seen.get["rows"]


def outside_domain(df: DataFrame, column: str, domain) -> DataFrame:
    """Values not in the fixed list; expect none."""
    known = df.sparkSession.createDataFrame([(v,) for v in domain], f"`{column}` string")
    return df.select(column).distinct().join(known, column, "left_anti")


def check_table(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, violations, passed) for row predicates, all in one pass. NULL counts as a violation."""
    row = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"__{i}") for i, c in enumerate(checks.values())])
    cols = ", ".join(f"'{name}', `__{i}`" for i, name in enumerate(checks))
    return row.select(F.expr(f"stack({len(checks)}, {cols}) AS (check, violations)")) \
        .withColumn("passed", F.col("violations") == 0)


def total_check(df: DataFrame, name: str, total: Column, minimum: float) -> DataFrame:
    """X4 for a total over the table."""
    return df.agg(total.alias("value")).select(
        F.lit(name).alias("check"), F.col("value").cast("double").alias("value"),
        F.lit(float(minimum)).alias("minimum"),
        F.coalesce(F.col("value") > minimum, F.lit(False)).alias("passed"))


def require(checks: DataFrame) -> DataFrame:
    """Raise when a check table holds a failure."""
    bad = [r["check"] for r in checks.where(~F.col("passed")).select("check").collect()]
    if bad:
        raise CheckFailed(f"failed checks: {bad}")
    return checks
