"""The same features on nested documents: array columns only, no explode, no shuffle."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from erisk.functions import rules as R
from erisk.operators import history as H, model as M
from erisk.settings import ScopeRules, Settings
from erisk.sources.models import rules_from_block

# The texts given for records that cannot be scored.
NOT_COVERED = "Motorcycles and scooters aren't covered: this model is for cars and light vans."
NO_START = "No first-registration date on record."
WORK = ("__tests", "__cycles", "__start", "__pred", "__before", "__last", "__n")


def counted(test: Column, s: Settings, cond) -> Column:
    kind = lambda d: F.upper(d["type"]) if s.fold_result_case else d["type"]
    return F.size(F.filter(F.coalesce(test["defects"], F.array()), lambda d: cond(kind(d))))


def fail_items(test: Column, s: Settings) -> Column:
    return counted(test, s, lambda kind: kind.isin(*s.fail_types))


def advisories(test: Column, s: Settings) -> Column:
    return counted(test, s, lambda kind: kind == s.advisory_type)


def with_cycles(records: DataFrame, s: Settings, out: str = "__cycles") -> DataFrame:
    """The cycles of a document as an array of (at, day, failed, miles, fail_items, advisories)."""
    in_time = lambda d: d.isNotNull() if s.snapshot_end is None else d <= F.lit(s.snapshot_end).cast("date")
    tests = F.filter("motTests", lambda t: R.result_text(t["testResult"], s).isin(s.passed, s.failed)
                     & R.known_source(t["dataSource"], s) & in_time(R.day(t["completedDate"])))
    brief = F.transform(tests, lambda t: F.struct(
        t["completedDate"].alias("at"), (R.result_text(t["testResult"], s) != s.failed).alias("passed"),
        t["motTestNumber"].alias("id"), R.day(t["completedDate"]).alias("day"),
        (R.result_text(t["testResult"], s) == s.failed).cast("int").alias("failed"),
        R.reading(t["odometerValue"], t["odometerUnit"], t["odometerResultType"], s.km_factor).alias("miles"),
        fail_items(t, s).alias("fail_items"), advisories(t, s).alias("advisories")))
    # natural struct order: time, fail first, event id
    ordered = records.withColumn("__tests", F.sort_array(F.coalesce(brief, F.array())))
    kept = F.filter("__tests", lambda t, i: (i == 0) | (
        F.datediff(t["day"], F.get(F.col("__tests"), i - 1)["day"]) > s.gap_days))
    return ordered.withColumn(out, kept).drop("__tests")


def start(first="firstUsedDate", registered="registrationDate") -> Column:
    return R.start_day(first, registered, blank_is_missing=True)


def prediction_day(s: Settings, today: Column) -> Column:
    """The latest expiry of any pass, else the third anniversary, never before today; no start: today."""
    due = F.coalesce(latest_expiry(s), R.add_three_years(start()))
    return F.greatest(F.coalesce(due, today), today)


def latest_expiry(s: Settings) -> Column:
    """The latest expiry of any pass in a document."""
    return F.array_max(F.transform(
        F.filter("motTests", lambda t: (R.result_text(t["testResult"], s) == s.passed)
                 & (F.coalesce(t["expiryDate"], F.lit("")) != "")),
        lambda t: R.day(t["expiryDate"])))


def as_of_features(df: DataFrame, pred: str, cycles: str = "__cycles", start_col: str = "__start") -> DataFrame:
    """Features from the cycles strictly before the given day."""
    df = df.withColumn("__before", F.filter(cycles, lambda c: c["day"] < F.col(pred)))
    df = df.withColumn("__n", F.size("__before")).withColumn("__last", F.try_element_at("__before", F.lit(-1)))
    fails = lambda arr: F.aggregate(arr, F.lit(0), lambda acc, c: acc + c["failed"])
    some = F.col("__n") > 0
    # slice(-3) would return nothing for shorter arrays
    last3 = F.slice("__before", F.greatest(F.col("__n") - 2, F.lit(1)), F.lit(3))
    return df.select(
        *[c for c in df.columns if c not in ("__before", "__n", "__last", cycles, start_col)],
        R.age_years(F.col(pred), F.col(start_col)).alias("age_years"),
        F.when(some, fails(F.col("__before"))).cast("long").alias("n_prior_fails"),
        F.when(some, fails(last3)).cast("long").alias("fails_last_3"),
        F.col("__last.miles").alias("prev_odometer"),
        F.col("__last.fail_items").cast("long").alias("prev_fail_items"),
        F.col("__last.advisories").cast("long").alias("prev_advisories"),
        F.datediff(F.col(pred), F.col("__last.day")).cast("long").alias("days_since_prev"))


def split_parts(records: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Whole documents, and documents written in parts (see ``sources.records``); without a count a document is whole."""
    if "n_parts" not in records.columns:
        return records, None
    n = F.coalesce("n_parts", F.lit(1))
    return records.where(n == 1).drop("part", "n_parts"), records.where(n > 1).drop("part", "n_parts")


def features_at(records: DataFrame, dates: DataFrame, s: Settings) -> DataFrame:
    """N3 for many days per entity: ``dates`` has (registration, test_date).

    Days meet the short array of cycles, not the documents. Documents in parts take the relational way. Every event
    before a day counts, whatever the end of the training snapshot.
    """
    s = s.with_(snapshot_end=None)
    whole, parts = split_parts(records)
    brief = with_cycles(whole, s).select("registration", start().alias("__start"), "__cycles")
    out = as_of_features(dates.join(brief, "registration"), "test_date")
    if parts is None:
        return out
    people = people_of(parts, s).select("registration", "__start")
    ready = dates.join(people, "registration").join(cycle_arrays(parts, s), "registration", "left")
    return out.unionByName(as_of_features(with_empty(ready), "test_date").select(out.columns))


def people_of(parts: DataFrame, s: Settings) -> DataFrame:
    """Attributes and latest expiry of each entity, from its documents in parts."""
    known = lambda c: F.first(c, ignorenulls=True).alias(c)
    return (parts.where("registration IS NOT NULL").select("*", latest_expiry(s).alias("__expiry")).groupBy("registration")
            .agg(*[known(c) for c in ("make", "model", "firstUsedDate", "registrationDate")], F.max("__expiry").alias("__expiry"))
            .withColumn("__start", start()))


def counted_events(parts: DataFrame, s: Settings) -> DataFrame:
    """The events of documents in parts with their item counts: items are counted inside a document, so only events move.
    Parts of one event are merged; its count is that of all its items."""
    fields = {"motTestNumber": "mot_test_number", "completedDate": "completed_date", "testResult": "test_result",
              "odometerValue": "odometer_value", "odometerUnit": "odometer_unit", "odometerResultType": "odometer_result_type",
              "dataSource": "data_source"}
    tests = parts.select("registration", F.explode("motTests").alias("t")).select(
        "registration", *[F.col(f"t.{a}").alias(b) for a, b in fields.items()],
        advisories(F.col("t"), s).alias("n_advisory"), fail_items(F.col("t"), s).alias("n_fail_items"))
    merged = tests.repartition("mot_test_number").groupBy("registration", *fields.values()).agg(*[F.sum(c).alias(c) for c in H.COUNTED])
    total = lambda c: F.when(F.col("mot_test_number").isNotNull(), F.sum(c).over(Window.partitionBy("mot_test_number"))).otherwise(F.lit(0))
    return merged.select(*[c for c in merged.columns if c not in H.COUNTED], *[total(c).alias(c) for c in H.COUNTED])


def cycle_arrays(parts: DataFrame, s: Settings) -> DataFrame:
    """N1's relational twin for documents in parts: cycles are bounded per entity, so they fit one array."""
    table = H.cycle_table(counted_events(parts, s), None, s)
    return table.groupBy("registration").agg(F.sort_array(F.collect_list(F.struct(
        F.col("completed_date").cast("string").alias("at"), (F.col("failed") == 0).alias("passed"),
        F.col("mot_test_number").alias("id"), F.col("d").alias("day"), "failed", "miles",
        F.col("n_fail_items").cast("int").alias("fail_items"),
        F.col("n_advisory").cast("int").alias("advisories")))).alias("__cycles"))


def with_empty(df: DataFrame) -> DataFrame:
    return df.withColumn("__cycles", F.coalesce("__cycles", F.array().cast(dict(df.dtypes)["__cycles"])))


def without_texts(records: DataFrame) -> DataFrame:
    """Documents without the texts of their items, most of their bytes; no score reads them."""
    brief = lambda d: F.struct(d["type"].alias("type"), F.lit(None).cast("string").alias("text"), d["dangerous"].alias("dangerous"))
    return records.withColumn("motTests", F.transform("motTests", lambda t: t.withField("defects", F.transform(t["defects"], brief))))


def judged(df: DataFrame, model: dict, rules: ScopeRules) -> DataFrame:
    """N4's last step: scope, reasons, probability and band from features."""
    covered = R.in_scope("make", "model", rules) == 1
    supported = covered & F.col("age_years").isNotNull()
    out = df.withColumn("__make", R.clean_label("make", rules))
    p = M.probability(model, lambda c: F.col("__make") if c == "make" else F.col(c))
    out = out.withColumn("__p", F.when(supported, p))
    return out.select(
        "registration", "make", "model", supported.alias("supported"),
        F.when(~covered, NOT_COVERED).when(F.col("age_years").isNull(), NO_START).alias("message"),
        F.when(supported, F.col("__pred")).alias("due_date"),
        F.when(supported, M.band(model, F.col("__p"), F.col("age_years"))).alias("band"),
        F.round("__p", 3).alias("probability"),
        F.when(supported, F.col("n_prior_fails").isNull()).alias("first_mot"),
        *[F.when(supported, F.col(c)).alias(c) for c in M.NUMERIC],
        F.when(supported, F.lit(model.get("version"))).alias("model_version"))


def score_records(records: DataFrame, model: dict, s: Settings, today: Column,
                  rules: ScopeRules | None = None) -> DataFrame:
    """One narrow pass over whole documents; those in parts take the relational way.

    Rules of the record path: a missing source is kept, results are compared upper-cased, and events after the end of
    the training snapshot count like any other before the prediction day.
    """
    rules = rules or rules_from_block(model["vehicle_rules"])
    s = s.with_(null_source_ok=True, fold_result_case=True, snapshot_end=None)
    whole, parts = split_parts(records)
    ready = with_cycles(whole.withColumn("__pred", prediction_day(s, today)), s).select(
        "registration", "make", "model", "__pred", start().alias("__start"), "__cycles")
    out = judged(as_of_features(ready, "__pred"), model, rules)
    if parts is None:
        return out
    due = F.greatest(F.coalesce(F.col("__expiry"), R.add_three_years(start()), today), today)
    people = people_of(parts, s).select("registration", "make", "model", due.alias("__pred"), "__start")
    built = with_empty(people.join(cycle_arrays(parts, s), "registration", "left"))
    return out.unionByName(judged(as_of_features(built, "__pred"), model, rules))


# Tolerances of the parity check.
TOLERANCE = {"age_years": 0.0101, "probability": 1e-4}
OTHER_TOLERANCE = 1e-6


def parity(expected: DataFrame, got: DataFrame, keys, fields, tolerance: dict = TOLERANCE) -> DataFrame:
    """(keys, field, ok) for every expected row; NULL equals NULL, numbers within tolerance.

    A row missing on either side is a mismatch of every field.
    """
    types = dict(expected.dtypes)
    a = expected.select(*keys, F.lit(True).alias("__in_a"), *[F.col(f).alias(f"a_{f}") for f in fields])
    b = got.select(*keys, F.lit(True).alias("__in_b"), *[F.col(f).alias(f"b_{f}") for f in fields])
    both = a.join(b, list(keys), "full_outer")
    present = F.col("__in_a").isNotNull() & F.col("__in_b").isNotNull()
    checks = []
    for f in fields:
        left, right = F.col(f"a_{f}"), F.col(f"b_{f}")
        same = left.eqNullSafe(right)
        if types[f] not in ("string", "date", "boolean"):
            near = F.abs(left.cast("double") - right.cast("double")) <= tolerance.get(f, OTHER_TOLERANCE)
            same = same | F.coalesce(near, F.lit(False))
        checks.append(F.struct(F.lit(f).alias("field"), (present & same).alias("ok")))
    return both.select(*keys, F.explode(F.array(*checks)).alias("c")).select(*keys, "c.field", "c.ok")
