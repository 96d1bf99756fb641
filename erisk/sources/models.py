"""Model parameters as one nested JSON row, with rules and provenance."""
from __future__ import annotations

from datetime import date

from pyspark.sql import SparkSession, types as T

from erisk.settings import ScopeRules

NUMBERS = T.MapType(T.StringType(), T.DoubleType())
WORDS = T.ArrayType(T.StringType())
MODEL_SCHEMA = T.StructType([
    T.StructField("preprocessing", T.StructType([
        T.StructField("fill_values", NUMBERS), T.StructField("means", NUMBERS), T.StructField("sds", NUMBERS),
        T.StructField("makes", WORDS)])),
    T.StructField("columns", WORDS),
    T.StructField("coefficients", T.ArrayType(T.DoubleType())),
    T.StructField("intercept", T.DoubleType()),
    T.StructField("calibration", T.StructType([
        T.StructField("method", T.StringType()), T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])),
    T.StructField("bands", T.StructType([
        T.StructField("method", T.StringType()),
        T.StructField("cutoffs_by_age", T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))])),
    T.StructField("name", T.StringType()), T.StructField("version", T.StringType()),
    T.StructField("built", T.StringType()), T.StructField("scope", T.StringType()),
    T.StructField("vehicle_rules", T.StructType([
        T.StructField("make_merges", T.MapType(T.StringType(), T.StringType())),
        T.StructField("excluded_makes", WORDS),
        T.StructField("car_models", T.MapType(T.StringType(), WORDS)),
        T.StructField("bmw_bike_regex", T.StringType()), T.StructField("unknown_models", WORDS)])),
    T.StructField("training", T.StructType([
        T.StructField("sample_pct", T.LongType()), T.StructField("train_cycles", T.LongType()),
        T.StructField("validation_cycles", T.LongType()), T.StructField("train_fail_rate", T.DoubleType()),
        T.StructField("validation_auc_raw", T.DoubleType())])),
])


def rules_block(rules: ScopeRules) -> dict:
    return {"make_merges": rules.merges, "excluded_makes": sorted(rules.excluded),
            "car_models": {k: sorted(v) for k, v in rules.allowed_first_words.items()},
            "bmw_bike_regex": rules.denied_patterns.get("BMW"), "unknown_models": sorted(rules.unknown_models)}


def rules_from_block(block: dict) -> ScopeRules:
    pattern = block.get("bmw_bike_regex")
    return ScopeRules(merges=dict(block["make_merges"]), excluded=tuple(block["excluded_makes"]),
                      allowed_first_words={k: tuple(v) for k, v in block["car_models"].items()},
                      denied_patterns={"BMW": pattern} if pattern else {},
                      unknown_models=tuple(block["unknown_models"]))


def with_provenance(model: dict, rules: ScopeRules, training: dict, name: str, version: str, scope: str,
                    built: str | None = None) -> dict:
    """M19."""
    return {**model, "name": name, "version": version, "built": built or date.today().isoformat(), "scope": scope,
            "vehicle_rules": rules_block(rules), "training": training}


def save_model(spark: SparkSession, model: dict, path: str) -> None:
    """One row, one part file."""
    row = {f.name: model.get(f.name) for f in MODEL_SCHEMA.fields}
    spark.createDataFrame([row], MODEL_SCHEMA).coalesce(1).write.mode("errorifexists").json(path)


def load_model(spark: SparkSession, path: str) -> dict:
    """A folder written by ``save_model`` or a single pretty-printed JSON file."""
    return spark.read.schema(MODEL_SCHEMA).option("multiLine", True).json(path).first().asDict(recursive=True)
