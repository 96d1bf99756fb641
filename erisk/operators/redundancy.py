"""Redundancy between features: Spearman matrix, strong pairs, variance inflation."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from erisk.operators import scan
from erisk.session import durable


def complete_cases(df: DataFrame, features) -> DataFrame:
    """P31."""
    return df.na.drop(subset=list(features))


#: A feature with at most this many distinct values takes its ranks from a broadcast map.
MAP_ROWS = 50_000


def rank_table(df: DataFrame, key: str, features, map_rows: int = MAP_ROWS) -> DataFrame:
    """Average ranks of every feature, one row per key.

    Ranks are computed once per distinct (feature, value), by offsets of blocks. A feature whose distinct values were counted
    to be few has a map of them broadcast; only a feature with more moves rows, once, with the ranks found so far. Nothing is
    unpivoted with the rows, and nothing is put together by key.
    """
    features = list(features)
    rows = durable(complete_cases(df, features).select(key, *[F.col(f).cast("double").alias(f) for f in features]))
    pairs = ", ".join(f"'{f}', `{f}`" for f in features)
    long = rows.select(F.expr(f"stack({len(features)}, {pairs}) AS (feature, value)"))
    bounds = scan.value_bounds(long, ["value"])["value"]
    cell_df = scan.cells(long, ["feature"], "value", {"n": F.lit(1)}, bounds)
    ranks = durable(scan.running(cell_df, ["feature"], "value", ["n"]).select(
        "feature", "value", (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank")))
    distinct = {r["feature"]: r["count"] for r in ranks.groupBy("feature").count().collect()}
    for f in sorted(features, key=lambda f: distinct.get(f, 0)):
        own = ranks.where(F.col("feature") == f).select(F.col("value").alias(f), F.col("rank").alias(f"__rank_{f}"))
        own = F.broadcast(own) if distinct.get(f, 0) <= map_rows else own.hint("merge")
        rows = rows.join(own, f)
    return rows.select(key, *[F.col(f"__rank_{f}").alias(f) for f in features])


def correlation_pairs(df: DataFrame, features) -> DataFrame:
    """Pearson correlation of each pair in one aggregation: (feature_a, feature_b, r)."""
    features = list(features)
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    row = df.agg(*[F.corr(a, b).alias(f"__{i}") for i, (a, b) in enumerate(pairs)])
    cols = ", ".join(f"'{a}', '{b}', `__{i}`" for i, (a, b) in enumerate(pairs))
    return row.select(F.expr(f"stack({len(pairs)}, {cols}) AS (feature_a, feature_b, r)"))


def spearman_pairs(df: DataFrame, key: str, features) -> DataFrame:
    """Rank correlation with ties averaged, one row per pair."""
    return correlation_pairs(rank_table(df, key, features), features)


def strong_pairs(pairs: DataFrame, cut: float = 0.5) -> DataFrame:
    """Pairs at or over the cut, strongest first."""
    return pairs.where(F.abs("r") >= cut).orderBy(F.desc(F.abs("r")), "feature_a", "feature_b")


def vif(df: DataFrame, features) -> DataFrame:
    """The diagonal of the inverse correlation matrix; the k x k matrix comes from one scan."""
    features = list(features)
    place = {f: i for i, f in enumerate(features)}
    matrix = np.eye(len(features))
    for r in correlation_pairs(complete_cases(df, features), features).collect():   # k(k-1)/2 rows
        value = float("nan") if r["r"] is None else r["r"]
        matrix[place[r["feature_a"]], place[r["feature_b"]]] = value
        matrix[place[r["feature_b"]], place[r["feature_a"]]] = value
    try:
        values = np.diag(np.linalg.inv(matrix))
    except np.linalg.LinAlgError:
        values = [float("inf")] * len(features)
    out = df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, vif double")
    return out.withColumn("flag", F.when(F.col("vif") > 10, "high").when(F.col("vif") > 5, "check").otherwise(""))


def strength_table(coefficients: DataFrame, alone: DataFrame, vifs: DataFrame) -> DataFrame:
    """Coefficient, AUC of the feature alone and VIF, by feature."""
    return coefficients.join(alone, "feature").join(vifs.select("feature", "vif"), "feature")
