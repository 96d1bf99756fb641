"""Small statistics as column expressions (A17, A29, sigmoid, logit, odds)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def wilson(fails: Column, n: Column, z: float = 1.96, digits: int | None = 1) -> tuple[Column, Column]:
    """Wilson score interval of a proportion, in percent."""
    fails, n = fails.cast("double"), n.cast("double")
    p = fails / n
    denom = F.lit(1.0) + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (n * 2)) / denom
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (n * n * 4)) / denom
    low, high = (centre - half) * 100, (centre + half) * 100
    return (low, high) if digits is None else (F.round(low, digits), F.round(high, digits))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def logit(p: Column, eps: float = 1e-6) -> Column:
    """Log-odds, with the probability kept off 0 and 1."""
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.ln(q / (1 - q))


def odds(p: Column) -> Column:
    return F.try_divide(p, 1 - p)


def gini(auc: Column) -> Column:
    return auc * 2 - 1


def psi_label(value: Column) -> Column:
    """M18."""
    return F.when(value < 0.1, "stable").when(value < 0.25, "monitor").otherwise("unstable")
