"""Pilot comparison: baseline, logistic and boosting with and without text features."""
from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from erisk.functions.bands import right_closed
from erisk.functions.rules import age_int, collapse, generation, one_hot, split_label
from erisk.operators import boosting, metrics, model as M, reports, resampling
from erisk.plans.training import LABEL
from erisk.session import durable
from erisk.settings import Settings

BASE_NUMERIC = ("age_years", "reg_year", "engine_size", "n_prior_cycles", "n_prior_fails", "prev_failed",
                "prev_advisories", "prev_fail_items", "prev_minors", "days_since_prev")
TEXT_FEATURES = tuple(f"prev_adv_{c}" for c in ("tyres", "brakes", "suspension", "steering", "leaks", "other",
                                                "corrosion", "tyre_limit"))
# Fuels with a column of their own.
MAIN_FUELS = ("DIESEL", "PETROL", "HYBRID ELECTRIC (CLEAN)", "ELECTRIC DIESEL")


def prepare(df: DataFrame, s: Settings, fuels=MAIN_FUELS) -> tuple[DataFrame, list[str]]:
    """Generation, whole age and fuel columns."""
    fuel = collapse("fuel_type", fuels, "OTHER")
    labels = [*fuels, "OTHER"]
    names = [f"fuel_{i}" for i in range(len(labels))]
    hot = [c.alias(n) for c, n in zip(one_hot(fuel, labels, "fuel_"), names)]
    return (df.select("*", generation(F.col("reg_year"), s).alias("gen"), age_int(F.col("age_years")).alias("age_int"),
                      split_label("test_date", s).alias("split"), *hot), names)


def compare(features: DataFrame, s: Settings, fuels=MAIN_FUELS, key: str = "mot_test_number",
            boosting_rounds: int = 500, text_features=TEXT_FEATURES, boost: bool = True) -> dict:
    """Scores of five models on the validation rows (three without boosting), their predictions and coefficients."""
    prepared, fuel_names = prepare(features, s, fuels)
    data = durable(prepared.where(F.col("split") != "test"))
    train, val = data.where("split = 'train'"), data.where("split = 'validation'")
    base = [*BASE_NUMERIC, *fuel_names]
    sets = {"": base, " + text": [*base, *text_features]}
    scored = reports.baseline_predict(train, val, ["gen", "age_int"], "gen", LABEL, s.min_cell, out="score")
    parts = [scored.select(F.lit("Baseline (gen + age)").alias("model"), key, LABEL, "age_int", "score")]
    fitted, coefficients = {}, {}
    boosters = boosting.fit(train, sets, LABEL, key, boosting_rounds) if boost else {}
    for suffix, columns in sets.items():
        logistic, coefs = M.pilot_logistic(train, columns, LABEL)
        coefficients[f"Logistic{suffix}"] = coefs
        scorers = {f"Logistic{suffix}": logistic} | ({f"Boosting{suffix}": boosters[suffix].score} if boost else {})
        for name, score in scorers.items():
            fitted[name] = (score, columns)
            parts.append(score(val).select(F.lit(name).alias("model"), key, LABEL, "age_int", "score"))
    preds = durable(functools.reduce(DataFrame.unionByName, parts))
    base_rate = train.agg(F.avg(LABEL)).first()[0]
    table = metrics.auc(preds, LABEL, "score", ["model"]).select("model", "auc").join(
        metrics.score_summary(preds, LABEL, "score", base_rate, ["model"]), "model")
    return {"scores": table, "predictions": preds, "coefficients": coefficients, "fitted": fitted, "validation": val}


def importances(compared: dict, model: str = "Boosting + text", key: str = "mot_test_number", repeats: int = 5) -> DataFrame:
    score, columns = compared["fitted"][model]
    val = compared["validation"].select(key, LABEL, *[F.col(c).cast("double").alias(c) for c in columns])
    return resampling.permutation_importance(val, key, LABEL, columns, score, repeats)


def peer_bands(predictions: DataFrame, model: str) -> DataFrame:
    """Bands by percent rank among peers of the same whole age."""
    cells = reports.peer_cells(predictions.where(F.col("model") == model), "age_int", "score", LABEL)
    return reports.rate_by_band(cells, right_closed("peer_pct", [0, 40, 80, 100], list(M.BANDS)))
