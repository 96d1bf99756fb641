"""Ranking, calibration and stability metrics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from erisk.operators import scan
from erisk.operators.scan import BLOCK


# ---- discrimination -----------------------------------------------------------

def auc_from_cells(cell_df: DataFrame, score: str, groups=()) -> DataFrame:
    """AUC per group from cells (group, score, pos, neg, block); ties count half.

    Only block totals cross blocks, so nothing is joined back: a pair is counted either inside
    its block or through the block's offset.
    """
    groups = list(groups)
    inside = Window.partitionBy(*groups, BLOCK).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0.0))
    per_block = (cell_df.select(*groups, BLOCK, score, F.col("pos").cast("double").alias("pos"),
                                F.col("neg").cast("double").alias("neg"))
                 .withColumn("__below", below)
                 .groupBy(*groups, BLOCK)
                 .agg(F.sum(F.col("pos") * (F.col("__below") + F.col("neg") * 0.5)).alias("win"),
                      F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    blocks_before = Window.partitionBy(*groups).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    shifted = per_block.withColumn("__off", F.coalesce(F.sum("neg").over(blocks_before), F.lit(0.0)))
    out = shifted.groupBy(*groups).agg(
        F.sum(F.col("win") + F.col("pos") * F.col("__off")).alias("__win"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.select(*groups, F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"),
                      F.try_divide(F.col("__win"), F.col("n_pos") * F.col("n_neg")).alias("auc"))


def score_cells(df: DataFrame, label: str, score: str, groups=(), bounds=None, weight=None) -> DataFrame:
    w = F.lit(1) if weight is None else weight
    known = df.where(F.col(label).isNotNull())
    return scan.cells(known, list(groups), score,
                      {"pos": F.col(label) * w, "neg": (1 - F.col(label)) * w}, bounds)


def auc(df: DataFrame, label: str, score: str, groups=(), bounds=None, weight=None) -> DataFrame:
    """Exact, tie-corrected ROC AUC per group. One-class groups give NULL.

    ``bounds`` balances the work for scores outside [0, 1]; see ``scan.value_bounds``.
    """
    return auc_from_cells(score_cells(df, label, score, groups, bounds, weight), score, groups)


def roc_points(df: DataFrame, label: str, score: str, groups=(), bounds=None) -> DataFrame:
    """False and true positive rates at every distinct score, from the highest down."""
    groups = list(groups)
    run = scan.running(score_cells(df, label, score, groups, bounds), groups, score, ["pos", "neg"])
    return run.select(*groups, F.col(score).alias("threshold"),
                      F.try_divide(F.col("total_neg") - F.col("before_neg"), F.col("total_neg")).alias("fpr"),
                      F.try_divide(F.col("total_pos") - F.col("before_pos"), F.col("total_pos")).alias("tpr"))


def score_summary(df: DataFrame, label: str, score: str, base_rate: Column | float, groups=(),
                  eps: float = 1e-15) -> DataFrame:
    """Brier score, Brier skill against a constant rate, log loss, calibration gap in one pass."""
    y, p = F.col(label).cast("double"), F.col(score)
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    base = F.lit(float(base_rate)) if isinstance(base_rate, (int, float)) else base_rate
    grouped = df.groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(y).alias("actual"),
        F.avg((p - y) * (p - y)).alias("brier"), F.avg((base - y) * (base - y)).alias("__ref"),
        F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"))
    return grouped.select(*groups, "n", "mean_predicted", "actual", "brier",
                          (1 - F.try_divide(F.col("brier"), F.col("__ref"))).alias("brier_skill"), "log_loss",
                          ((F.col("mean_predicted") - F.col("actual")) * 100).alias("gap_points"))


# ---- calibration --------------------------------------------------------------

def quantile_edges(df: DataFrame, value: str, bins: int = 10, bounds=None) -> list[float]:
    """Distinct quantile edges; at most ``bins + 1`` numbers reach the driver."""
    rows = scan.quantiles(df, value, [i / bins for i in range(bins + 1)], bounds=bounds).select("quantile").collect()
    return sorted({r["quantile"] for r in rows})


def edge_bucket(value: Column, edges, right: bool = True) -> Column:
    """0-based bin between learned edges. Right-closed with the lowest included, or left-closed."""
    inner = list(edges[1:-1])
    out = F.lit(0)
    for i, e in enumerate(inner, start=1):
        cond = (value > e) if right else (value >= e)
        out = F.when(cond, F.lit(i)).otherwise(out)
    return F.when(value.isNotNull(), out)


def edges_of(cell_df: DataFrame, value: str, weight: str, bins: int, bounds=None) -> Column:
    """The distinct quantile edges of aggregated rows as one sorted array, without a second job."""
    found = scan.quantiles(cell_df, value, [i / bins for i in range(bins + 1)], bounds=bounds, weight=F.col(weight))
    return found.agg(F.sort_array(F.collect_set("quantile"))).scalar()   # at most bins + 1 numbers


def bucket_in(value: str, edges: str, right: bool = True) -> Column:
    """``edge_bucket`` against an array column of edges."""
    inner = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.size(F.filter(inner, (lambda e: e < F.col(value)) if right else (lambda e: e <= F.col(value))))


def calibration_bins(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Predicted against actual per predicted-score bin; duplicate edges are dropped.

    Edges and bins both read the (score -> count, outcomes) cells, so rows are folded once.
    """
    folded = df.where(F.col(score).isNotNull()).groupBy(score).agg(
        F.count("*").alias("n"), F.sum(F.col(label)).alias("__y"))
    binned = folded.withColumn("__e", edges_of(folded, score, "n", bins)) \
        .withColumn("bin", bucket_in(score, "__e").cast("long"))
    return (binned.groupBy("bin").agg((F.sum(F.col(score) * F.col("n")) / F.sum("n")).alias("predicted"),
                                      (F.sum("__y") / F.sum("n")).alias("actual"), F.sum("n").alias("n"))
            .withColumn("gap_points", (F.col("predicted") - F.col("actual")) * 100))


def calibration_summary(bins: DataFrame) -> DataFrame:
    """One row of size-weighted and worst gaps over the bins."""
    total, gap = F.sum("n"), F.abs("gap_points")
    return bins.agg(
        (F.sum(F.col("predicted") * F.col("n")) / total * 100).alias("mean_predicted_pct"),
        (F.sum(F.col("actual") * F.col("n")) / total * 100).alias("actual_pct"),
        (F.sum(gap * F.col("n")) / total).alias("average_gap_points"),
        F.max(gap).alias("worst_gap_points"),
        (F.min("predicted") * 100).alias("lowest_predicted_pct"),
        (F.max("predicted") * 100).alias("highest_predicted_pct"),
        F.count("*").alias("points"))


# ---- stability ----------------------------------------------------------------

def psi_from_counts(counts: DataFrame, keys, label: str, expected: str, actual: str, eps: float = 1e-6) -> DataFrame:
    """PSI per key from one row per (key, label) with two counts."""
    w = Window.partitionBy(*keys)
    e = F.col(expected) / F.sum(expected).over(w) + eps
    a = F.col(actual) / F.sum(actual).over(w) + eps
    parts = counts.select(*keys, e.alias("__e"), a.alias("__a"))
    return parts.groupBy(*keys).agg(
        F.sum((F.col("__a") - F.col("__e")) * F.ln(F.col("__a") / F.col("__e"))).alias("psi"))


def psi_score(df: DataFrame, score: str, is_expected: Column, is_actual: Column, bins: int = 10) -> DataFrame:
    """PSI of a score: quantile edges of the expected rows, open ends, left-closed bins."""
    folded = df.where(F.col(score).isNotNull()).groupBy(score).agg(
        F.count_if(is_expected).alias("n_expected"), F.count_if(is_actual).alias("n_actual"))
    edges = edges_of(folded.where(F.col("n_expected") > 0), score, "n_expected", bins)
    binned = folded.withColumn("__e", edges)
    counted = binned.groupBy(bucket_in(score, "__e", right=False).alias("bin")).agg(
        F.sum("n_expected").alias("x"), F.sum("n_actual").alias("y"))
    total = counted.agg(F.sum("x").alias("x"), F.sum("y").alias("y"),
                        F.collect_list(F.struct("x", "y")).alias("bins"))   # one row of at most ``bins`` pairs
    share = lambda b: F.struct((b["x"] / F.col("x") + 1e-6).alias("e"), (b["y"] / F.col("y") + 1e-6).alias("a"))
    part = lambda s: (s["a"] - s["e"]) * F.ln(s["a"] / s["e"])
    # bins without any row have equal shares on both sides and add nothing
    return total.select(F.aggregate(F.transform("bins", share), F.lit(0.0), lambda acc, s: acc + part(s)).alias("psi"))


# ---- segments -----------------------------------------------------------------

def segment_report(df: DataFrame, dimensions: dict[str, str], label: str, score: str, min_size: int = 500,
                   gate_auc: float = 0.58, gate_gap: float = 5.0) -> DataFrame:
    """Size, rate, AUC, calibration gap and gate per (dimension, segment), all dimensions in one pass.

    Rows are first folded to cells of all dimensions and the score, then unpivoted, so each
    dimension sees cells and not rows. NULL segments and one-class segments are left out.
    """
    cols = list(dict.fromkeys(dimensions.values()))
    folded = (df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
              .groupBy(*cols, score).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg")))
    pairs = ", ".join(f"'{name}', CAST(`{c}` AS STRING)" for name, c in dimensions.items())
    long = folded.select(score, "pos", "neg", F.expr(f"stack({len(dimensions)}, {pairs}) AS (dimension, segment)")) \
        .where(F.col("segment").isNotNull())
    keys = ["dimension", "segment"]
    cell_df = scan.cells(long, keys, score, {"pos": F.col("pos"), "neg": F.col("neg")})
    ranked = auc_from_cells(cell_df, score, keys)
    means = cell_df.groupBy(*keys).agg(
        (F.sum(F.col(score) * (F.col("pos") + F.col("neg"))) / F.sum(F.col("pos") + F.col("neg"))).alias("__p"))
    out = ranked.join(means, keys).where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    n = F.col("n_pos") + F.col("n_neg")
    rate = F.col("n_pos") / n
    gap = (F.col("__p") - rate) * 100
    ok = (F.col("auc") >= gate_auc) & (F.abs(gap) <= gate_gap)
    return out.select(*keys, n.alias("n"), rate.alias("fail_rate"), "auc", gap.alias("calibration_gap_points"),
                      F.when(n < min_size, "too small").when(ok, "pass").otherwise("FAIL").alias("result"))
