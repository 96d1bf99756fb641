"""Univariate analysis of every candidate feature in one scan."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from erisk.functions.rules import split_label
from erisk.operators import binning as B, quality as Q
from erisk.session import durable
from erisk.settings import Settings


@dataclass
class Univariate:
    rules: B.BinRules
    cells: DataFrame
    binned: DataFrame
    bins: DataFrame

    def summary(self) -> DataFrame:
        return B.summary(self.cells, self.bins, self.rules)

    def by_year(self) -> DataFrame:
        return B.rate_by_year(self.binned)


def analyse(features: DataFrame, numeric, categorical, s: Settings, label: str = "target_failed",
            date: str = "test_date") -> Univariate:
    """Learn bins on train, apply to validation. The test period is left out.

    The folded cells are kept durable: rules, tables and reports all read them, not the rows.
    """
    Q.require_columns(features, [*numeric, *categorical, label, date])
    split = features.withColumn("split", split_label(date, s)).where(F.col("split") != "test") \
        .withColumn("year", F.year(date))
    cells = durable(B.feature_cells(split, numeric, categorical, label, "split", "year"))
    rules = B.learn(cells, numeric, categorical)
    binned = B.binned_cells(cells, rules)
    return Univariate(rules, cells, binned, B.bin_table(binned, rules))
