"""Logistic regression by Newton steps over summed Gram matrices (M5-M9).

A step is one pass: each task sums w x x' and the residuals of its rows in one matrix product per batch, these k x k numbers
are added up in Spark, and the k x k system is solved where the job is started. Nothing depends on the number of rows but the
pass itself. Steps are halved while the penalised loss would rise, so fits without a penalty do not run away.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from erisk.session import durable, ship_package

MAX_STEPS, TOLERANCE = 50, 1e-10


def step_sums(weights: list[float]):
    """Sums of a task: the Gram matrix and the residual vector side by side, then the loss, as (place, value)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(weights)
        k = len(w)
        total = np.zeros((k, k + 1))
        loss = 0.0
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([b.column("x").combine_chunks().flatten().to_numpy() if isinstance(b.column("x"), pa.ChunkedArray)
                                 else b.column("x").flatten().to_numpy()]).reshape(b.num_rows, k - 1)
            x = np.column_stack([x, np.ones(len(x))])
            y, z = b.column("y").to_numpy(), x @ w
            p = 1 / (1 + np.exp(-z))
            total[:, :k] += (x * (p * (1 - p))[:, None]).T @ x
            total[:, k] += x.T @ (p - y)
            loss += float((np.logaddexp(0, z) - y * z).sum())
        flat = np.append(total.ravel(), loss)
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(flat)), pa.int32()), "value": pa.array(flat, pa.float64())})
    return run


def fit_logistic(df: DataFrame, columns, label: str, c: float = 1.0, max_steps: int = MAX_STEPS,
                 tol: float = TOLERANCE) -> tuple[list[float], float]:
    """M5, M6: L2 logistic regression, 0.5 |b|^2 + c times the sum of losses; the intercept is free. Rows without an outcome
    are left out."""
    columns = list(columns)
    ship_package(df.sparkSession)
    rows = durable(df.where(F.col(label).isNotNull()).select(
        F.array(*[F.col(x).cast("double") for x in columns]).alias("x"), F.col(label).cast("double").alias("y")))
    k = len(columns) + 1
    penalty = np.append(np.full(k - 1, 1.0 / c), 0.0)

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        found = rows.mapInArrow(step_sums(w.tolist()), "place int, value double").groupBy("place").agg(F.sum("value").alias("v")).collect()
        flat = np.zeros(k * (k + 1) + 1)
        for r in found:
            flat[r["place"]] = r["v"]
        both = flat[:-1].reshape(k, k + 1)
        return both[:, :k] + np.diag(penalty), both[:, k] + penalty * w, float(flat[-1] + 0.5 * penalty @ (w * w))

    w = np.zeros(k)
    gram, slope, loss = sums(w)
    for _ in range(max_steps):
        move = np.linalg.lstsq(gram, slope, rcond=None)[0]
        while True:
            new = w - move
            gram, slope, new_loss = sums(new)
            if new_loss <= loss + 1e-9 * abs(loss) or np.abs(move).max() < tol:
                break
            move = move / 2
        w, loss = new, new_loss
        if np.abs(move).max() < tol * (1 + np.abs(w).max()):
            break
    return w[:-1].tolist(), float(w[-1])
