"""Fit, calibrate, set peer bands and export; then validate once against the gates."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from erisk.functions.bands import age_key, right_closed
from erisk.functions.rules import collapse, split_label
from erisk.functions.stats import logit, psi_label, sigmoid
from erisk.operators import metrics, model as M, reports, resampling
from erisk.session import durable
from erisk.settings import ScopeRules, Settings
from erisk.sources.models import with_provenance

LABEL = "target_failed"
# The names of the gates, in the order of the report.
GATES = ("Beats the baseline, intervals not overlapping", "Calibration slope 0.9 to 1.1",
         "Bands rise from Lower to Typical to Higher risk", "No segment fails AUC or calibration", "Score PSI below 0.25")


@dataclass
class Trained:
    model: dict
    scores: DataFrame      # validation: baseline, raw, calibrated


def train(features: DataFrame, s: Settings, rules: ScopeRules, n_makes: int = 20, min_group: int = 200,
          name: str = "Failure model", version: str = "1.0", scope: str = "") -> Trained:
    """Learn on train, calibrate and cut on validation. The test rows are not read."""
    # one durable table feeds the statistics, the fit, the calibration and the cut-offs
    data = durable(features.withColumn("split", split_label("test_date", s)).where(F.col("split") != "test")
                   .withColumn("age_key", age_key("age_years")))
    train_rows, val = data.where("split = 'train'"), data.where("split = 'validation'")
    model = M.fit_model(train_rows, LABEL, n_makes)
    z_val = val.withColumn("z", M.raw_logit(model))
    a, b = M.fit_platt(z_val, F.col("z"), LABEL)
    model["calibration"] = {"method": "platt", "a": a, "b": b}
    ready = z_val.withColumn("p_raw", sigmoid(F.col("z"))).withColumn("p", M.probability(model))
    ready = reports.rate_lookup(train_rows, ready, "age_key", LABEL, "p_base")
    model["bands"] = M.bands_block(M.learn_cutoffs(ready, "p", min_group=min_group))
    sizes = data.groupBy("split").agg(F.count("*").alias("n"), F.avg(LABEL).alias("rate"))
    size = {r["split"]: r for r in sizes.collect()}   # two rows
    scores = durable(score_table(ready, ["p_base", "p_raw", "p"], size["train"]["rate"]))
    raw_auc = scores.where(F.col("score") == "p_raw").first()["auc"]
    model = with_provenance(model, rules, {
        "sample_pct": s.sample_pct, "train_cycles": size["train"]["n"], "validation_cycles": size["validation"]["n"],
        "train_fail_rate": size["train"]["rate"], "validation_auc_raw": raw_auc}, name, version, scope)
    return Trained(model, scores)


def score_table(df: DataFrame, scores, base_rate: float, label: str = LABEL) -> DataFrame:
    """AUC, Brier skill and log loss of several scores, unpivoted and measured together."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in scores)
    long = df.select(label, F.expr(f"stack({len(scores)}, {pairs}) AS (score, value)"))
    return metrics.auc(long, label, "value", ["score"]).select("score", "auc").join(
        metrics.score_summary(long, label, "value", base_rate, ["score"]), "score")


def validate(features: DataFrame, model: dict, s: Settings, reps: int = 200, segment_min: int = 500,
             key: str = "mot_test_number") -> dict:
    """Score the test rows once and check every gate. Returns the tables of the report."""
    data = durable(features.withColumn("split", split_label("test_date", s)).where(F.col("split") != "validation")
                   .withColumn("age_key", age_key("age_years")).withColumn("p", M.probability(model)))
    train_rows, test = data.where("split = 'train'"), data.where("split = 'test'")
    test = durable(reports.rate_lookup(train_rows, test, "age_key", LABEL, "p_base")
                   .withColumn("band", M.band(model, F.col("p"), F.col("age_years")))
                   .withColumn("make_seg", collapse("make", model["preprocessing"]["makes"], "OTHER MAKES"))
                   .withColumn("age_seg", F.coalesce(right_closed("age_years", [0, 5, 8, 11, 15, 100],
                                                                  ["3-5", "5-8", "8-11", "11-15", "15+"]), F.lit("nan")))
                   .withColumn("history_seg", F.when(F.col("n_prior_fails").isNull(), "no history").otherwise("has history")))
    base_rate = train_rows.agg(F.avg(LABEL)).first()[0]
    scores = score_table(test, ["p", "p_base"], base_rate)
    interval = resampling.bootstrap_interval(resampling.bootstrap_auc(test, key, LABEL, ["p", "p_base"], reps))
    slope, intercept = M.fit_platt(test, logit(F.col("p"), 1e-15), LABEL)
    bins = metrics.calibration_bins(test, LABEL, "p")
    bands = reports.rate_by(test, ["band"], LABEL)
    segments = metrics.segment_report(test, {"make": "make_seg", "fuel": "fuel_type", "age band": "age_seg",
                                             "history": "history_seg"}, LABEL, "p", segment_min)
    psi = metrics.psi_score(data, "p", F.col("split") == "train", F.col("split") == "test")
    return {"scores": scores, "interval": interval, "calibration": (slope, intercept), "bins": bins, "bands": bands,
            "segments": segments, "psi": psi.select("psi", psi_label(F.col("psi")).alias("label")),
            "gates": gate_table(interval, slope, bands, segments, psi)}


def gate_table(interval: DataFrame, slope: float, bands: DataFrame, segments: DataFrame, psi: DataFrame) -> DataFrame:
    """Five one-row checks."""
    spark = bands.sparkSession
    low = interval.where(F.col("score") == "p").agg(F.max("low")).scalar()
    high = interval.where(F.col("score") == "p_base").agg(F.max("high")).scalar()
    failed = segments.where(F.col("result") == "FAIL").agg(F.count("*")).scalar()
    rising = reports.bands_in_order(bands, M.BANDS).agg(F.bool_and("rising")).scalar()
    one = spark.range(1)
    row = lambda name, value, ok: F.struct(F.lit(name).alias("gate"), value.cast("double").alias("value"),
                                           F.coalesce(ok, F.lit(False)).alias("passed"))
    return one.select(
        (low - high).alias("margin"), failed.alias("failed"), rising.alias("rising"),
        psi.agg(F.max("psi")).scalar().alias("psi"), F.lit(float(slope)).alias("slope")).select(F.explode(F.array(
            row(GATES[0], F.col("margin"), F.col("margin") > 0),
            row(GATES[1], F.col("slope"), F.col("slope").between(0.9, 1.1)),
            row(GATES[2], F.col("rising").cast("int"), F.col("rising")),
            row(GATES[3], F.col("failed"), F.col("failed") == 0),
            row(GATES[4], F.col("psi"), F.col("psi") < 0.25))).alias("g")).select("g.*")


def report_lines(result: dict) -> DataFrame:
    """The report as (position, line), rendered in Spark from the small result tables, in a fixed order: bands as
    they rise, segments by dimension and name, gates as they are checked."""
    slope, intercept = result["calibration"]
    spark = result["gates"].sparkSession
    summary = metrics.calibration_summary(result["bins"])
    segments, gated = result["segments"], F.col("result") != "too small"
    counts = segments.agg(F.count("*").alias("n"), F.count_if(gated).alias("gated"), F.count_if(F.col("result") == "FAIL").alias("failed"))
    place = lambda known, c: F.coalesce(F.array_position(F.lit(list(known)), F.col(c)), F.lit(len(known) + 1))
    one = F.lit(0)
    named = F.when(F.col("score") == "p", "Model").otherwise("Age-only baseline")
    parts = [
        (spark.range(1), one, F.lit("Validation on the test rows")),
        (result["scores"].join(result["interval"], "score"), place(["p", "p_base"], "score"), F.format_string(
            "%s AUC %.3f (%.3f to %.3f), Gini %.3f", named, "auc", "low", "high", 2 * F.col("auc") - 1)),
        (spark.range(1), one, F.lit(f"Calibration slope {slope:.3f} (gate 0.9 to 1.1), intercept {intercept:+.3f}")),
        (summary, one, F.format_string("Mean predicted %.1f%%, actual %.1f%%, %+.1f points", "mean_predicted_pct", "actual_pct",
                                       F.col("mean_predicted_pct") - F.col("actual_pct"))),
        (result["scores"].where("score = 'p'"), one, F.format_string("Brier skill %.3f", "brier_skill")),
        (summary, one, F.format_string("Worst decile %.1f points", "worst_gap_points")),
        (result["bands"], place(M.BANDS, "band"), F.format_string("%s %.1f%% fail (%d rows)", "band", F.col("fail_rate") * 100, "n")),
        (counts, one, F.format_string("%d segments checked, %d gated", "n", "gated")),
        (counts.where("failed = 0"), one, F.lit("all gated segments pass")),
        (segments.where("result = 'FAIL'"), F.struct("dimension", "segment"), F.format_string(
            "FAIL %s: %s AUC %.3f, gap %+.1f points, %d rows", "dimension", "segment", "auc", "calibration_gap_points", "n")),
        (result["psi"], one, F.format_string("Score PSI %.3f (%s)", "psi", "label")),
        (result["gates"], place(GATES, "gate"), F.format_string("%s  %s", F.when(F.col("passed"), "PASS").otherwise("FAIL"), "gate"))]
    lines = None
    for k, (df, order, line) in enumerate(parts):
        inside = F.row_number().over(Window.orderBy(order))       # report tables only: a few dozen rows
        df = df.select((inside + k * 100_000).alias("position"), line.alias("line"))
        lines = df if lines is None else lines.unionByName(df)
    return lines
