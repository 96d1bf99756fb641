"""The risk model: parameters as data, scoring as column expressions, fitting by Newton steps."""
from __future__ import annotations

import copy
import functools
import operator

from pyspark.sql import Column, DataFrame, functions as F

from erisk.functions.bands import AGE_KEYS, age_key
from erisk.functions.stats import logit, sigmoid
from erisk.operators import scan
from erisk.operators.newton import fit_logistic

NUMERIC = ("age_years", "n_prior_fails", "fails_last_3", "prev_odometer",
           "prev_fail_items", "prev_advisories", "days_since_prev")
ZERO_IF_NO_HISTORY = ("n_prior_fails", "fails_last_3", "prev_fail_items", "prev_advisories")
EXPECTED_POSITIVE = NUMERIC[:6]
BANDS = ("Lower risk", "Typical", "Higher risk")
# Readable units per feature.
UNITS = {"age_years": (1, "per year"), "n_prior_fails": (1, "per fail"), "fails_last_3": (1, "per fail"),
         "prev_odometer": (10_000, "per 10,000 miles"), "prev_fail_items": (1, "per fail item"),
         "prev_advisories": (1, "per advisory"), "days_since_prev": (30, "per 30 days")}


# ---- scoring ------------------------------------------------------------------

def fill_of(model: dict, c: str) -> float:
    return 0.0 if c in ZERO_IF_NO_HISTORY else float(model["preprocessing"]["fill_values"][c])


def design_columns(model: dict, col=F.col) -> dict[str, Column]:
    """One expression per column of the model, by the kind its name tells: number, flag or label."""
    centre, scale = model["preprocessing"]["means"], model["preprocessing"]["sds"]
    blank = {c: col(c).isNull() for c in ("n_prior_fails", "prev_odometer")}
    flags = {"no_history": blank["n_prior_fails"], "odometer_missing": blank["prev_odometer"] & ~blank["n_prior_fails"]}

    def number(c: str) -> Column:
        value = F.when(col(c).isNull(), F.lit(fill_of(model, c))).otherwise(col(c).cast("double"))
        return (value - float(centre[c])) / float(scale[c])

    def column(name: str) -> Column:
        if name in NUMERIC:
            return number(name)
        test = flags[name] if name in flags else F.coalesce(col("make"), F.lit("UNKNOWN")) == name.removeprefix("make_")
        return test.cast("double")

    return {name: column(name) for name in model["columns"]}


def raw_logit(model: dict, col=F.col) -> Column:
    """M2: log-odds before calibration, one arithmetic expression."""
    terms = [x * F.lit(float(b)) for x, b in zip(design_columns(model, col).values(), model["coefficients"])]
    return functools.reduce(operator.add, terms, F.lit(float(model["intercept"])))


def probability(model: dict, col=F.col) -> Column:
    """M3: Platt-calibrated probability."""
    c = model["calibration"]
    return sigmoid(F.lit(float(c["a"])) * raw_logit(model, col) + F.lit(float(c["b"])))


def band_limits(model: dict, key: Column) -> Column:
    """The two cut-offs of a peer key; a key the model does not know raises."""
    cuts = F.create_map(*[x for k, (lo, hi) in model["bands"]["cutoffs_by_age"].items()
                          for x in (F.lit(k), F.array(F.lit(float(lo)), F.lit(float(hi))))])
    return F.coalesce(F.try_element_at(cuts, key),
                      F.raise_error(F.concat(F.lit("no band cut-offs for peer key "), F.coalesce(key, F.lit("NULL"))))
                      .cast("array<double>"))


def band(model: dict, p: Column, age: Column) -> Column:
    """M4: below the first cut-off, below the second, or at or above it."""
    limits = band_limits(model, age_key(age))
    return F.when(p < limits[0], BANDS[0]).when(p < limits[1], BANDS[1]).otherwise(BANDS[2])


def scored(df: DataFrame, model: dict, p="p", band_col: str | None = "band") -> DataFrame:
    out = df.withColumn(p, probability(model))
    return out if band_col is None else out.withColumn(band_col, band(model, F.col(p), F.col("age_years")))


def override(model: dict, zero_prefix: str | None = None, calibration: tuple | None = None, **fields) -> dict:
    """An edited copy of the parameters (a column group switched off, calibration reset)."""
    out = copy.deepcopy(model)
    if zero_prefix is not None:
        out["coefficients"] = [0.0 if c.startswith(zero_prefix) else b
                               for c, b in zip(out["columns"], out["coefficients"])]
    if calibration is not None:
        out["calibration"] = {"method": "platt", "a": calibration[0], "b": calibration[1]}
    out.update(fields)
    return out


def contributions(df: DataFrame, model: dict, key: str) -> DataFrame:
    """Per row and column the value, coefficient and product; negligible products are left out."""
    parts = F.array(*[F.struct(F.lit(n).alias("column"), x.alias("value"), F.lit(float(b)).alias("coefficient"),
                               (x * F.lit(float(b))).alias("contribution"))
                      for (n, x), b in zip(design_columns(model).items(), model["coefficients"])])
    return (df.select(key, F.explode(parts).alias("c")).where(F.abs("c.contribution") > 1e-9)
              .select(key, "c.column", "c.value", "c.coefficient", "c.contribution"))


# ---- coefficient reports ---------------------------------------------------------

def coefficient_table(spark, model: dict) -> DataFrame:
    """Odds ratio and sign check per column."""
    rows = [(i, c, float(b)) for i, (c, b) in enumerate(zip(model["columns"], model["coefficients"]))]
    return spark.createDataFrame(rows, "position int, feature string, coefficient double").select(
        "position", "feature", "coefficient", F.exp("coefficient").alias("odds_ratio"),
        F.when(F.col("feature").isin(*EXPECTED_POSITIVE) & (F.col("coefficient") <= 0), "unexpected sign")
         .otherwise("").alias("sign_check"))


def readable_units(spark, model: dict, units: dict = UNITS) -> DataFrame:
    """Effect per unit and per readable unit."""
    prep, coef = model["preprocessing"], dict(zip(model["columns"], model["coefficients"]))
    rows = [(f, float(prep["means"][f]), float(prep["sds"][f]), float(coef[f]), float(units[f][0]), units[f][1])
            for f in NUMERIC]
    return spark.createDataFrame(rows, "feature string, mean double, sd double, coefficient double, k double, unit string") \
        .select("feature", "mean", "sd", "coefficient", F.exp("coefficient").alias("odds_ratio_per_sd"),
                (F.col("coefficient") / F.col("sd")).alias("per_unit"), "unit",
                F.exp(F.col("k") * F.col("coefficient") / F.col("sd")).alias("odds_ratio_per_readable_unit"))


def refit_difference(saved: dict, refit: dict) -> float:
    """The largest coefficient difference between two fits of the same columns."""
    if saved["columns"] != refit["columns"]:
        raise ValueError("the two models have different columns")
    return max(abs(a - b) for a, b in zip(saved["coefficients"], refit["coefficients"]))


# ---- learning -------------------------------------------------------------------

def learn_preprocessing(train: DataFrame, n_makes: int = 20) -> dict:
    """Fills, means, sample deviations and the most frequent makes, from train only."""
    wanted = [c for c in NUMERIC if c not in ZERO_IF_NO_HISTORY]
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in wanted)
    long = train.select(F.col("n_prior_fails").isNotNull().alias("__hist"),
                        F.expr(f"stack({len(wanted)}, {pairs}) AS (feature, value)")) \
        .where(F.col("__hist") | (F.col("feature") == "age_years"))
    bounds = scan.value_bounds(long, ["value"])["value"]
    medians = {r["feature"]: r["quantile"] for r in scan.quantiles(long, "value", [0.5], ["feature"], bounds).collect()}
    fills = {c: 0.0 if c in ZERO_IF_NO_HISTORY else float(medians[c]) for c in NUMERIC}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(fills[c])) for c in NUMERIC}
    row = train.agg(*[F.avg(x).alias(f"m_{c}") for c, x in filled.items()],
                    *[F.stddev_samp(x).alias(f"s_{c}") for c, x in filled.items()]).first()
    top = train.where(F.col("make").isNotNull()).groupBy("make").count() \
        .orderBy(F.desc("count"), "make").limit(n_makes).collect()
    makes = [r["make"] for r in top]
    return {"fill_values": fills, "means": {c: float(row[f"m_{c}"]) for c in NUMERIC},
            "sds": {c: float(row[f"s_{c}"]) for c in NUMERIC}, "makes": makes}


def model_columns(prep: dict) -> list[str]:
    return [*NUMERIC, "no_history", "odometer_missing", *[f"make_{m}" for m in prep["makes"]]]


def fit_model(train: DataFrame, label: str, n_makes: int = 20, c: float = 1.0) -> dict:
    """Preprocessing, design matrix and fit on the train rows."""
    prep = learn_preprocessing(train, n_makes)
    model = {"preprocessing": prep, "columns": model_columns(prep)}
    matrix = train.select(*[x.alias(f"x{i}") for i, x in enumerate(design_columns(model).values())], label)
    names = [f"x{i}" for i in range(len(model["columns"]))]
    model["coefficients"], model["intercept"] = fit_logistic(matrix, names, label, c)
    return model


def fit_platt(df: DataFrame, z: Column, label: str) -> tuple[float, float]:
    """M7, M8: slope and intercept of the outcome on the log-odds, practically unpenalised."""
    coefs, intercept = fit_logistic(df.select(z.alias("z"), label), ["z"], label, c=1e6)
    return coefs[0], intercept


def platt_of_probability(fit_on: DataFrame, p: str, label: str):
    """Platt scaling of any probability: returns a column function to apply elsewhere."""
    a, b = fit_platt(fit_on, logit(F.col(p)), label)
    return lambda q: sigmoid(F.lit(a) * logit(q) + F.lit(b))


def learn_cutoffs(df: DataFrame, p: str, age: str = "age_years", min_group: int = 200,
                  probs=(0.4, 0.8)) -> DataFrame:
    """Exact cut-offs per peer key; small groups take the overall ones. Every key is present."""
    keyed = df.select(age_key(F.col(age)).alias("age_key"), p)
    by_key = scan.quantiles(keyed, p, probs, ["age_key"])
    wide = [F.max(F.when(F.col("prob") == probs[i], F.col("quantile"))).alias(name) for i, name in enumerate(("low", "high"))]
    groups = by_key.groupBy("age_key").agg(F.max("n").alias("n"), *wide)
    overall = scan.quantiles(keyed, p, probs).agg(F.struct(*wide)).scalar()
    keys = df.sparkSession.createDataFrame([(k,) for k in AGE_KEYS], "age_key string")
    enough = F.coalesce(F.col("n"), F.lit(0)) >= min_group
    return keys.join(groups, "age_key", "left").select(
        "age_key", F.coalesce(F.col("n"), F.lit(0)).alias("n"),
        *[F.when(enough, F.col(c)).otherwise(overall[c]).alias(c) for c in ("low", "high")])


def bands_block(cutoffs: DataFrame) -> dict:
    rows = {r["age_key"]: [r["low"], r["high"]] for r in cutoffs.collect()}   # one row per peer key
    return {"method": "cut at quantiles 0.4 and 0.8 of the calibrated score within each age key of the validation split",
            "cutoffs_by_age": {k: rows[k] for k in AGE_KEYS}}


# ---- pilot models ------------------------------------------------------------------

def impute_median(train: DataFrame, columns):
    """M9: medians from train; returns a function adding filled columns, one flag per column blank in train,
    and the model's column names."""
    columns = list(columns)
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    long = train.select(F.expr(f"stack({len(columns)}, {pairs}) AS (feature, value)"))
    bounds = scan.value_bounds(long, ["value"])["value"]
    medians = {r["feature"]: r["quantile"] for r in scan.quantiles(long, "value", [0.5], ["feature"], bounds).collect()}
    blanks = train.agg(*[F.max(F.col(c).isNull()).alias(c) for c in columns]).first()
    flagged = [c for c in columns if blanks[c]]
    names = [f"v_{c}" for c in columns] + [f"blank_{c}" for c in flagged]

    def apply(df: DataFrame) -> DataFrame:
        return df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c, 0.0))).alias(f"v_{c}")
                                for c in columns],
                         *[F.col(c).isNull().cast("double").alias(f"blank_{c}") for c in flagged])
    return apply, names


def standardise(train: DataFrame, names):
    """Mean and population deviation from train; returns a function replacing the columns."""
    row = train.agg(*[F.avg(n).alias(f"m_{i}") for i, n in enumerate(names)],
                    *[F.stddev_pop(n).alias(f"s_{i}") for i, n in enumerate(names)]).first()

    def apply(df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in names]
        return df.select(*keep, *[((F.col(n) - F.lit(row[f"m_{i}"])) / F.lit(row[f"s_{i}"] or 1.0)).alias(n)
                                  for i, n in enumerate(names)])
    return apply


def pilot_logistic(train: DataFrame, features, label: str):
    """M9: impute, flag, scale, fit. Returns (df -> df with ``score``, coefficients by column)."""
    impute, names = impute_median(train, features)
    scale = standardise(impute(train), names)
    coefs, intercept = fit_logistic(scale(impute(train)), names, label)

    def score(df: DataFrame) -> DataFrame:
        ready = scale(impute(df))
        z = functools.reduce(operator.add, [F.col(n) * F.lit(b) for n, b in zip(names, coefs)], F.lit(intercept))
        return ready.withColumn("score", sigmoid(z)).drop(*names)
    return score, dict(zip(names, coefs))
