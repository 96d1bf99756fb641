"""Chart data: fail rate by generation and age (first event per entity and year of age)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from erisk.functions import rules as R
from erisk.operators import history as H, quality as Q, reports
from erisk.settings import Settings


def chart_points(entities: DataFrame, events: DataFrame, s: Settings, member=None) -> DataFrame:
    people = H.prepare_entities(entities, member=member)
    chosen = events if member is None else events.join(people.select("registration"), "registration", "left_semi")
    first = H.first_per_age_year(people, chosen, s, start=s.regime_date)
    return reports.chart_points(first, R.generation(F.col("reg_year"), s), s.min_age, s.min_cell)


def chart_checks(points: DataFrame, s: Settings, min_total: int = 10_000) -> DataFrame:
    """X1-X4 on the chart: known labels, rates in range, no small cell, interval around the rate, enough events."""
    return Q.check_table(points, {
        "known generation": F.col("generation").isin(*s.generation_order),
        "rate in range": F.col("fail_pct").between(0, 100),
        "no small cell": F.col("tests") >= s.min_cell,
        "rate inside interval": (F.col("ci_low") <= F.col("fail_pct")) & (F.col("fail_pct") <= F.col("ci_high")),
    }).select("check", "passed").unionByName(
        Q.total_check(points, "enough events", F.sum("tests"), min_total).select("check", "passed"))
