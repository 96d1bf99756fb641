"""Given tables as entities (customer, nation), events (orders) and items (lineitem, part)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from erisk.functions.rules import split_label
from erisk.operators import history as H, model as M
from erisk.settings import ScopeRules, Settings, TextRules

SETTINGS = Settings(
    regime_date="1998-01-01", snapshot_end="2001-02-28", validation_start="2000-01-01", test_start="2000-09-01",
    sample_pct=100, generations=((1992, "G1"), (1993, "G2"), (1994, "G3"), (1995, "G4")), last_generation="G5")
SCOPE = ScopeRules(merges={"HOUSEHOLD": "HOME"}, excluded=(), allowed_first_words={}, denied_patterns={})
PART_SCOPE = ScopeRules(
    merges={"ECONOMY": "BASIC", "STANDARD": "BASIC"}, excluded=("PROMO",),
    allowed_first_words={"LARGE": ("RED", "BLUE", "HOT"), "SMALL": ("OLD", "NEW", "COLD", "SMALL")},
    denied_patterns={"MEDIUM": r"^(HOT|COLD) (RING|ROD)"}, unknown_models=("", "UNKNOWN"))
ITEM_TEXT = TextRules(
    notes=("gizmo",), code_pattern=r"\([0-9]\.[0-9]",
    codes=(("tyres", ("(1.",)), ("suspension", ("(2.1.", "(2.3.")), ("brakes", ("(2.",)), ("steering", ("(3.",)),
           ("leaks", ("(4.",))),
    keywords=(("tyres", ("ring",)), ("brakes", ("plate",)), ("steering", ("bolt", "hot rod")), ("other", ("widget",)),
              ("leaks", ("gear",)), ("suspension", ("anvil", "rod"))),
    flags=(("corrosion", "red"), ("tyre_limit", "old")))
DOCUMENT_TOPICS = (("contact", ("@", "phone", "email")), ("licence", ("license", "licence", "copyright")),
                   ("secret", ("password", "secret", "token", "key")), ("web", ("http", "www", "cookie")),
                   ("table", (" | ",)))
DOCUMENT_NOTES = ("click here", "subscribe", "share this", "read more")

# Fixed parameters of the scoring queries (not learnt: every run and engine uses the same numbers).
MODEL = {
    "preprocessing": {
        "fill_values": {"age_years": 6.1, "n_prior_fails": 0.0, "fails_last_3": 0.0, "prev_odometer": 248000.0,
                        "prev_fail_items": 0.0, "prev_advisories": 0.0, "days_since_prev": 240.0},
        "means": {"age_years": 6.2, "n_prior_fails": 1.9, "fails_last_3": 1.2, "prev_odometer": 231000.0,
                  "prev_fail_items": 1.3, "prev_advisories": 1.3, "days_since_prev": 330.0},
        "sds": {"age_years": 1.6, "n_prior_fails": 1.4, "fails_last_3": 0.9, "prev_odometer": 141000.0,
                "prev_fail_items": 1.2, "prev_advisories": 1.2, "days_since_prev": 250.0},
        "makes": ["FURNITURE", "MACHINERY", "BUILDING", "AUTOMOBILE"]},
    "columns": [*M.NUMERIC, "no_history", "odometer_missing", "make_FURNITURE", "make_MACHINERY", "make_BUILDING",
                "make_AUTOMOBILE"],
    "coefficients": [0.1, 0.15, 0.23, 0.19, 0.1, 0.14, 0.05, -0.46, -0.07, 0.19, 0.29, -0.13, 0.25],
    "intercept": -0.15,
    "calibration": {"method": "platt", "a": 0.98, "b": -0.03},
    "bands": {"method": "fixed", "cutoffs_by_age": {
        **{str(a): [0.42 + 0.005 * a, 0.5 + 0.006 * a] for a in range(3, 25)}, "25+": [0.55, 0.66]}},
    "version": "fixed",
}


SCHEMAS: dict = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its schema is read from the footer once, not once per query."""
    path = f"{sf}/{name}.parquet"
    if path not in SCHEMAS:
        SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(SCHEMAS[path]).parquet(path)


def entities(spark: SparkSession, sf: str) -> DataFrame:
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    offset = ((F.col("c_custkey") * 37) % 1500).cast("int")
    balance = F.col("c_acctbal")
    return customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select(
        F.col("c_custkey").cast("string").alias("registration"), F.col("c_mktsegment").alias("make"),
        F.col("c_name").alias("model"),
        F.when(balance >= 1000, F.date_add(F.lit("1992-01-01").cast("date"), offset)).alias("first_used_date"),
        F.when(balance.between(-800, 9000), F.date_add(F.lit("1992-01-15").cast("date"), offset)).alias("registration_date"),
        F.col("n_name").alias("fuel_type"), balance.alias("engine_size"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("mot_test_number"), F.col("o_custkey").cast("string").alias("registration"),
        F.col("o_orderdate").alias("completed_date"),
        F.when(status == "F", "FAILED").when(status == "O", "PASSED").otherwise("ABANDONED").alias("test_result"),
        F.col("o_totalprice").alias("odometer_value"),
        F.when(priority.startswith("2"), "km").otherwise("mi").alias("odometer_unit"),
        F.when(priority.startswith("4"), "NO_ODOMETER").otherwise("READ").alias("odometer_result_type"),
        F.when(status == "O", F.date_add(F.to_date("o_orderdate"), 365)).alias("expiry_date"),
        F.when(priority.startswith("5"), "dvsa").otherwise("DVSA").alias("data_source"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    code = F.when(F.col("p_brand").startswith("Brand#1"), F.concat(
        F.lit(" ("), F.floor(F.col("p_size") / 10).cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"),
        F.lit(".1)"))).otherwise("")
    named = part.select("p_partkey", F.concat("p_name", F.lit(" "), "p_type", code).alias("text"))
    return line.join(named, line["l_partkey"] == named["p_partkey"]).select(
        F.col("l_orderkey").cast("string").alias("mot_test_number"),
        F.when(F.col("l_returnflag") == "A", "ADVISORY").when(F.col("l_returnflag") == "R", "MAJOR")
         .otherwise("MINOR").alias("type"), "text", (F.col("l_linestatus") == "F").alias("dangerous"))


def item_types(spark: SparkSession, sf: str) -> DataFrame:
    """Items without their text, for jobs that only count types."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("mot_test_number"),
        F.when(F.col("l_returnflag") == "A", "ADVISORY").when(F.col("l_returnflag") == "R", "MAJOR")
         .otherwise("MINOR").alias("type"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return H.cycle_features(entities(spark, sf), events(spark, sf), item_types(spark, sf), SETTINGS, SCOPE)


def text_features(spark: SparkSession, sf: str, leaky: bool = False) -> DataFrame:
    return H.cycle_features_text(entities(spark, sf), events(spark, sf), items(spark, sf), SETTINGS, ITEM_TEXT, leaky=leaky)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Features with probability, band and split. Scores keep 12 digits: engines whose exp differs in
    the last bit then agree about ties."""
    return (features(spark, sf).withColumn("p", F.round(M.probability(MODEL), 12))
            .withColumn("band", M.band(MODEL, F.col("p"), F.col("age_years")))
            .withColumn("split", split_label("test_date", SETTINGS)))
