"""Parity cases: records of chosen entities beside the values the relational path expects."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from erisk.operators import model as M, nested as N, sampling as SP
from erisk.session import durable
from erisk.settings import Settings
from erisk.sources.tables import RECORD_SCHEMA


def build_cases(scored: DataFrame, records: DataFrame | Callable[[DataFrame, int], DataFrame], pools: dict, sizes: dict, entity: str = "registration",
                row_key: str = "mot_test_number") -> DataFrame:
    """One case per sampled row: its pool, day, whole record and expected features, label, probability and band.

    ``scored`` has features, ``p`` and ``band``. ``records`` are the documents, or a function that builds those of the
    entities listed in a table, given a limit of its rows. Documents in parts give one case per part.
    """
    picked = SP.sample_pools(scored, pools, sizes, entity, row_key)
    if not isinstance(records, DataFrame):
        picked = durable(picked)
        records = records(picked.select(entity).distinct(), sum(sizes[p] for p in pools))
    vehicle = records.select(entity, F.struct(*[F.col(f.name) for f in RECORD_SCHEMA.fields]).alias("vehicle"))
    numbers = F.create_map(*[x for c in M.NUMERIC for x in (F.lit(c), F.col(c).cast("double"))])
    return picked.join(vehicle, entity).select(
        F.col("pool").alias("group"), F.col("test_date").alias("target_date"), "vehicle",
        F.struct(numbers.alias("features"), "make", F.col("p").alias("probability"), "band").alias("expected"))


def check_cases(cases: DataFrame, model: dict, s: Settings) -> DataFrame:
    """(group, registration, target_date, field, ok): every case computed anew from its record."""
    keys = ["registration", "target_date"]
    want = cases.select("group", "vehicle.registration", "target_date", "expected.make", "expected.band",
                        F.col("expected.probability").alias("p"), *[F.col("expected.features")[c].alias(c) for c in M.NUMERIC])
    dates = want.select("registration", F.col("target_date").alias("test_date")).distinct()
    features = N.features_at(cases.select("vehicle.*").distinct(), dates, s).withColumnRenamed("test_date", "target_date")
    got = M.scored(features.join(want.select(*keys, "make").distinct(), keys), model)
    checks = N.parity(want.drop("group").distinct(), got, keys, [*M.NUMERIC, "p", "band"], {"age_years": 0.0101, "p": 1e-4})
    return want.select("group", *keys).join(checks, keys)
