"""Registered queries: name -> (spark, sf_dir) -> DataFrame. Each runs over the whole given tables."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from erisk.functions import bands as BD, rules as R, text as TX
from erisk.functions.stats import gini, psi_label, sigmoid, wilson
from erisk.operators import binning as B, history as H, metrics as MT, model as M, nested as N, quality as Q, \
    redundancy as RD, reports as RP, resampling as RS, sampling as SP, scan
from erisk.plans import chart, parity, pilot, training, univariate
from erisk.session import durable, shared_folder
from erisk.sources import models as MF, records as RC, tables as TB
from erisk.sources.models import with_provenance
from erisk.streaming import cycles as SC, jobs
from workload import roles as W

QUERIES: dict = {}
LABEL = "target_failed"
COUNTS = ("n_prior_cycles", "n_prior_fails", "fails_last_3", "prev_fail_items", "prev_advisories")
SMOOTH = ("age_years", "prev_odometer", "days_since_prev")
CATEGORIES = ("make", "fuel_type")
SEGMENTS = {"make": "make_seg", "fuel": "fuel_type", "age band": "age_seg", "history": "history_seg"}
STREAM_GAP, STREAM_DELAY = "12 hours", "1 hour"


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounded once, at the very end (A40); whole numbers as bigint."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind == "boolean":
            c = c.cast("int").cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


def query(fn):
    QUERIES[fn.__name__] = lambda spark, sf: tidy(fn(spark, sf))
    return fn


# ---- feature tables ------------------------------------------------------------

@query
def cycle_features(spark, sf):
    return W.features(spark, sf)


@query
def cycle_features_text(spark, sf):
    return W.text_features(spark, sf, leaky=True)


@query
def flagged_history(spark, sf):
    events = H.prepare_events(W.events(spark, sf), W.SETTINGS)
    return H.flag_cycles(events, W.SETTINGS.gap_days).select(
        "registration", "mot_test_number", "d", "failed", "miles", "days_since_previous", "kept_as_cycle")


@query
def histories_of_failing(spark, sf):
    """S2 for many keys: raw events of every entity that failed its last three cycles."""
    keys = W.features(spark, sf).where("fails_last_3 = 3").select("registration")
    return H.history_of(W.events(spark, sf), keys).select("registration", "mot_test_number", "completed_date", "test_result",
                                                          "odometer_value")


@query
def chart_rate_by_age_group(spark, sf):
    return chart.chart_points(W.entities(spark, sf), W.events(spark, sf), W.SETTINGS)


@query
def chart_checks(spark, sf):
    points = chart.chart_points(W.entities(spark, sf), W.events(spark, sf), W.SETTINGS)
    return chart.chart_checks(points, W.SETTINGS, min_total=1_000)


@query
def family_cycles(spark, sf):
    member = R.family("AUTOMOBILE", "Customer#000000001", "^Customer#[0-9]*[02468]$")
    return chart.chart_points(W.entities(spark, sf), W.events(spark, sf), W.SETTINGS.with_(min_cell=5), member)


# ---- rules --------------------------------------------------------------------

@query
def hash_sample_entities(spark, sf):
    key = F.col("c_custkey").cast("string")
    return W.table(spark, sf, "customer").select(
        "c_custkey", R.hash_bucket(key).alias("bucket"), R.in_sample(key, 20).alias("in_sample"))


@query
def scope_and_normalise(spark, sf):
    part = W.table(spark, sf, "part")
    make, model = F.concat(F.lit("  "), F.lower("p_type"), F.lit(" ")), F.col("p_name")
    return part.select("p_partkey", R.clean_label(make, W.PART_SCOPE).alias("make"), R.clean_text(model).alias("model"),
                       R.in_scope(make, model, W.PART_SCOPE).alias("in_scope"),
                       R.clean_key(F.concat_ws(" ", "p_type", "p_size")).alias("clean_key"),
                       R.valid_key(F.concat_ws(" ", "p_type", "p_size")).cast("int").alias("valid_key"))


@query
def safety_net(spark, sf):
    return H.safety_net(W.entities(spark, sf), W.events(spark, sf), W.SETTINGS, W.SCOPE, ("FURNITURE", "BUILDING"),
                        small=2000)


@query
def rule_agreement(spark, sf):
    return H.rule_agreement(W.events(spark, sf), W.items(spark, sf), W.SETTINGS, W.ITEM_TEXT)


@query
def rule_agreement_by_code(spark, sf):
    return H.agreement_by_code(rule_agreement(spark, sf))


@query
def top_disagreements(spark, sf):
    return H.top_disagreements(rule_agreement(spark, sf), 5)


@query
def item_categories(spark, sf):
    """T5 item by item (with the event's day), counted by type and category."""
    s = W.SETTINGS
    day = W.events(spark, sf).select("mot_test_number", F.to_date("completed_date").alias("d"))
    return H.category_totals(W.items(spark, sf), day, s, W.ITEM_TEXT)


@query
def document_topics(spark, sf):
    lowered = F.lower("text")
    docs = W.table(spark, sf, "documents")
    return docs.select("doc_id", TX.has_any(lowered, W.DOCUMENT_NOTES).cast("int").alias("is_note"),
                       TX.first_match(lowered, W.DOCUMENT_TOPICS, "other").alias("topic"))


@query
def topic_quality(spark, sf):
    """Rate of a binary label by topic, with its Wilson interval."""
    docs = W.table(spark, sf, "documents").select(
        "doc_id", TX.first_match(F.lower("text"), W.DOCUMENT_TOPICS, "other").alias("topic"))
    labels = W.table(spark, sf, "labels").select("doc_id", "quality")
    rates = RP.rate_by(labels.join(docs, "doc_id"), ["topic"], "quality")
    low, high = wilson(F.col("fails"), F.col("n"), digits=None)
    return rates.select("topic", "n", "fails", "fail_rate", low.alias("ci_low"), high.alias("ci_high"))


# ---- rate tables ----------------------------------------------------------------

@query
def rate_by_bands(spark, sf):
    f = W.text_features(spark, sf)
    banded = {
        "fails_last_3": BD.first_edge("fails_last_3", [0, 1, 2], ["0", "1", "2", "3"]),
        "recurring": BD.first_edge("n_recurring_categories", [0, 1], ["0", "1", "2+"]),
        "trend": BD.first_edge("advisory_trend", [-1, 0], ["falling", "same", "rising"]),
        "before_regime": BD.first_edge("prev_test_before", [0], ["no", "yes"]),
        "annual": BD.first_edge("annual_miles_last_interval", [50000, 150000, 500000], ["<50k", "50-150k", "150-500k", "500k+"]),
        "had_tyres": BD.presence("prev_adv_tyres"),
        "had_corrosion": BD.presence("prev_adv_corrosion"),
        "days": F.coalesce(BD.left_closed("days_since_prev", [0, 330, 400, 500, 730, BD.INF],
                                          ["under 330", "330-400", "400-500", "500-730", "over 2 years"]), F.lit("missing"))}
    long = f.select(LABEL, F.explode(F.array(*[F.struct(F.lit(k).alias("banding"), c.alias("band"))
                                               for k, c in banded.items()])).alias("b")).select(LABEL, "b.*")
    return RP.rate_by(long, ["banding", "band"], LABEL)


@query
def top_categories(spark, sf):
    return RP.top_k(W.features(spark, sf), "fuel_type", 20)


@query
def table_totals(spark, sf):
    return RP.totals(W.features(spark, sf), LABEL, "registration", "n_prior_fails")


@query
def rate_pivot(spark, sf):
    f = W.features(spark, sf).where(F.col("make").isin("MACHINERY", "BUILDING"))
    edges, labels = [0, 3, 5, 6, 8, 40], ["0-3", "3-5", "5-6", "6-8", "8+"]
    return RP.rate_pivot(f, BD.right_closed("age_years", edges, labels), labels, F.col("make"),
                         ["MACHINERY", "BUILDING"], LABEL)


@query
def group_total_lift(spark, sf):
    f = W.features(spark, sf)
    groups = {"Goods": ["FURNITURE", "MACHINERY"], "Places": ["BUILDING", "HOME"]}
    band = BD.right_closed("prev_advisories", [-1, 0, 2, 100], ["0", "1-2", "3+"])
    return RP.group_total_lift(f, groups, "make", band, "0", "3+", LABEL, "prev_advisories")


def with_generation(df):
    return df.select("*", R.generation(F.col("reg_year"), W.SETTINGS).alias("gen"),
                     R.age_int(F.col("age_years")).alias("age_int"), R.split_label("test_date", W.SETTINGS).alias("split"))


@query
def baseline_lookup(spark, sf):
    f = with_generation(W.text_features(spark, sf))
    rows = RP.baseline_predict(f.where("split = 'train'"), f.where("split = 'validation'"), ["gen", "age_int"], "gen",
                               LABEL, W.SETTINGS.min_cell)
    return rows.select("mot_test_number", "gen", "age_int", "p_base")


@query
def age_rate_lookup(spark, sf):
    f = W.scored(spark, sf).withColumn("age_key", BD.age_key("age_years"))
    rows = RP.rate_lookup(f.where("split = 'train'"), f.where("split = 'test'"), "age_key", LABEL)
    return rows.select("mot_test_number", "age_key", "p_base")


@query
def peer_rank_rows(spark, sf):
    f = W.scored(spark, sf).withColumn("age_int", R.age_int(F.col("age_years")))
    return RP.peer_ranked(f, "age_int", "p", LABEL).select("mot_test_number", "age_int", "peer_pct")


@query
def peer_rank_bands(spark, sf):
    f = W.scored(spark, sf).withColumn("age_int", R.age_int(F.col("age_years")))
    cells = RP.peer_cells(f, "age_int", "p", LABEL)
    return RP.rate_by_band(cells, BD.right_closed("peer_pct", [0, 40, 80, 100], list(M.BANDS)))


@query
def band_share_by_age(spark, sf):
    f = W.scored(spark, sf).withColumn("age_key", BD.age_key("age_years"))
    return RP.band_share(f, "age_key", "band", M.BANDS, LABEL)


@query
def bands_in_order(spark, sf):
    return RP.bands_in_order(RP.rate_by(W.scored(spark, sf), ["band"], LABEL), M.BANDS)


@query
def odds_step_table(spark, sf):
    f = W.features(spark, sf).withColumn("recent", F.coalesce("fails_last_3", F.lit(0)))
    return RP.odds_steps(f, "recent", LABEL)


@query
def age_lookup_alignment(spark, sf):
    f = W.scored(spark, sf).withColumn("age_key", BD.age_key("age_years"))
    return RP.age_lookup(f.where("split = 'train'"), f.where("split = 'test'"), "age_key", LABEL, BD.AGE_KEYS)


@query
def ages_per_decile(spark, sf):
    f = W.scored(spark, sf).withColumn("age_key", BD.age_key("age_years"))
    rows = RP.rate_lookup(f.where("split = 'train'"), f.where("split = 'test'"), "age_key", LABEL)
    folded = rows.groupBy("p_base", "age_key").agg(F.count("*").alias("n"))
    binned = folded.withColumn("edges", MT.edges_of(folded, "p_base", "n", 10)) \
        .withColumn("decile", MT.bucket_in("p_base", "edges"))
    return RP.labels_per_group(binned, "decile", "age_key", BD.AGE_KEYS)


@query
def histogram(spark, sf):
    value = F.coalesce(F.col("days_since_prev").cast("double"), F.lit(240.0))
    return RP.histogram(W.features(spark, sf), value, 0.0, 50.0, {"n_filled": F.col("days_since_prev").isNull()})


@query
def missing_patterns(spark, sf):
    return RP.missing_patterns(W.features(spark, sf), "n_prior_fails",
                               ["fails_last_3", "prev_fail_items", "prev_advisories", "days_since_prev", "prev_odometer"],
                               "prev_odometer")


@query
def split_ranges(spark, sf):
    return RP.split_ranges(W.scored(spark, sf), "split", "test_date")


# ---- scoring ------------------------------------------------------------------

@query
def model_score(spark, sf):
    return W.scored(spark, sf).select("mot_test_number", M.raw_logit(W.MODEL).alias("z"), "p",
                                      BD.age_key("age_years").alias("age_key"), "band", "split")


@query
def contributions(spark, sf):
    return M.contributions(W.features(spark, sf), W.MODEL, "mot_test_number")


@query
def expected_vs_actual(spark, sf):
    off = M.override(W.MODEL, zero_prefix="make_", calibration=(1.0, 0.0))
    f = W.features(spark, sf).withColumn("expected", M.probability(off)) \
        .withColumn("make_grp", R.collapse("make", W.MODEL["preprocessing"]["makes"], "OTHER (reference)"))
    return RP.actual_expected(f, "make_grp", LABEL, "expected")


@query
def raw_vs_model_odds(spark, sf):
    makes = W.MODEL["preprocessing"]["makes"]
    coef = dict(zip(W.MODEL["columns"], W.MODEL["coefficients"]))
    f = W.features(spark, sf).withColumn("make_grp", R.collapse("make", makes, "OTHER (reference)"))
    return RP.raw_and_model_odds(f, "make_grp", "OTHER (reference)", LABEL, "age_years",
                                 {m: math.exp(coef[f"make_{m}"]) for m in makes})


# ---- metrics ------------------------------------------------------------------

@query
def auc_overall(spark, sf):
    return MT.auc(W.scored(spark, sf), LABEL, "p").withColumn("gini", gini(F.col("auc")))


@query
def auc_by_split(spark, sf):
    return MT.auc(W.scored(spark, sf), LABEL, "p", ["split"])


@query
def auc_of_feature(spark, sf):
    """AUC of one raw column outside [0, 1]: blocks from approximate bounds, result exact."""
    f = W.features(spark, sf).where(F.col("prev_odometer").isNotNull())
    return MT.auc(f, LABEL, "prev_odometer", bounds=scan.value_bounds(f, ["prev_odometer"])["prev_odometer"])


@query
def auc_by_segment(spark, sf):
    f = W.scored(spark, sf).withColumn("make_seg", R.collapse("make", W.MODEL["preprocessing"]["makes"][:3], "OTHER MAKES")) \
        .withColumn("age_seg", F.coalesce(BD.right_closed("age_years", [0, 5, 6, 7, 8, 100],
                                                          ["0-5", "5-6", "6-7", "7-8", "8+"]), F.lit("nan"))) \
        .withColumn("history_seg", F.when(F.col("n_prior_fails").isNull(), "no history").otherwise("has history"))
    return MT.segment_report(f, SEGMENTS, LABEL, "p", min_size=200, gate_auc=0.5)


@query
def roc_points(spark, sf):
    return MT.roc_points(W.scored(spark, sf), LABEL, "p")


@query
def brier_logloss(spark, sf):
    s = W.scored(spark, sf)
    base = s.where("split = 'train'").agg(F.avg(LABEL)).scalar()
    return MT.score_summary(s.withColumn("base", base), LABEL, "p", F.col("base"), ["split"])


@query
def calibration_deciles(spark, sf):
    return MT.calibration_bins(W.scored(spark, sf), LABEL, "p")


@query
def calibration_summary(spark, sf):
    return MT.calibration_summary(MT.calibration_bins(W.scored(spark, sf), LABEL, "p"))


@query
def psi_score(spark, sf):
    s = W.scored(spark, sf)
    return MT.psi_score(s, "p", F.col("split") == "train", F.col("split") == "test") \
        .withColumn("label", psi_label(F.col("psi")))


@query
def preprocessing_stats(spark, sf):
    train = durable(W.features(spark, sf).where(F.col("test_date") < F.lit(W.SETTINGS.validation_start).cast("date")))
    prep = M.learn_preprocessing(train, n_makes=3)
    rows = [(c, float(prep["fill_values"][c]), prep["means"][c], prep["sds"][c]) for c in M.NUMERIC]
    return spark.createDataFrame(rows, "feature string, fill_value double, mean double, sd double")


@query
def readable_units(spark, sf):
    """Fixed coefficients in readable units of the deviations learnt from the data."""
    train = durable(W.features(spark, sf).where(F.col("test_date") < F.lit(W.SETTINGS.validation_start).cast("date")))
    model = {**W.MODEL, "preprocessing": M.learn_preprocessing(train, n_makes=3)}
    return M.readable_units(spark, model).drop("mean")


@query
def fuels_outside_domain(spark, sf):
    """Values of the feature table that a fixed domain does not list."""
    return Q.outside_domain(W.features(spark, sf), "fuel_type", ["NATION_0", "NATION_1", "NATION_2", "NATION_3", "NATION_99"])


@query
def band_cutoffs(spark, sf):
    return M.learn_cutoffs(W.scored(spark, sf), "p", min_group=200)


@query
def feature_quantiles(spark, sf):
    f = W.features(spark, sf)
    bounds = scan.value_bounds(f, ["prev_odometer"])["prev_odometer"]
    return scan.quantiles(f, "prev_odometer", [i / 10 for i in range(11)], ["make"], bounds)


# ---- univariate ------------------------------------------------------------------

def analysed(spark, sf, numeric=(*SMOOTH, *COUNTS), categorical=CATEGORIES):
    return univariate.analyse(W.features(spark, sf), numeric, categorical, W.SETTINGS)


def coded(df, rules):
    """Bin labels of continuous features as b0, b1, ... in edge order."""
    code = None
    for f, edges in rules.edges.items():
        for i, label in enumerate(B.edge_labels(edges)):
            cond = (F.col("feature") == f) & (F.col("bin") == label)
            code = F.when(cond, f"b{i}") if code is None else code.when(cond, f"b{i}")
    return df if code is None else df.withColumn("bin", code.otherwise(F.col("bin")))


def bin_counts(u):
    return coded(u.bins, u.rules).select("feature", "bin", "n_train", "fails_train", "fail_rate_train", "n_val",
                                         "fail_rate_val")


@query
def bin_continuous(spark, sf):
    return bin_counts(analysed(spark, sf, SMOOTH, ()))


@query
def bin_count(spark, sf):
    return bin_counts(analysed(spark, sf, COUNTS, ()))


@query
def bin_category(spark, sf):
    return bin_counts(analysed(spark, sf, (), CATEGORIES))


@query
def woe_iv(spark, sf):
    u = analysed(spark, sf)
    return coded(u.bins, u.rules).where("n_train > 0").select("feature", "bin", "woe", "iv_part")


@query
def information_value(spark, sf):
    return B.information_value(analysed(spark, sf).bins)


@query
def psi_bins(spark, sf):
    return B.stability(analysed(spark, sf).bins)


@query
def bin_auc(spark, sf):
    return B.bin_auc(analysed(spark, sf).bins)


@query
def rate_by_bin_year(spark, sf):
    u = analysed(spark, sf)
    return coded(u.by_year(), u.rules)


@query
def monotonicity(spark, sf):
    u = analysed(spark, sf)
    return B.monotonicity(u.bins, u.rules).select("feature", "rho", F.col("monotonic").alias("verdict"))


@query
def column_profile(spark, sf):
    return B.profile(analysed(spark, sf).cells.where("split = 'train'")).drop("all_whole")


@query
def univariate_summary(spark, sf):
    out = analysed(spark, sf).summary()
    return out.select("feature", "missing_pct", "min", "max", "distinct_values", "bins", "iv", "auc_train", "auc_val",
                      "psi", "severity", "monotonic", "flags")


# ---- redundancy -----------------------------------------------------------------

RANKED = ("age_years", "n_prior_fails", "fails_last_3", "prev_odometer", "prev_fail_items", "days_since_prev")


@query
def spearman_matrix(spark, sf):
    return RD.spearman_pairs(W.features(spark, sf), "mot_test_number", RANKED)


@query
def strong_pairs(spark, sf):
    return RD.strong_pairs(RD.spearman_pairs(W.features(spark, sf), "mot_test_number", RANKED), 0.3)


@query
def vif(spark, sf):
    return RD.vif(W.features(spark, sf), ("age_years", "n_prior_fails", "fails_last_3"))


@query
def strength_table(spark, sf):
    f = W.features(spark, sf)
    names = ("age_years", "n_prior_fails", "fails_last_3")
    pairs = ", ".join(f"'{c}', CAST(coalesce(`{c}`, 0) AS DOUBLE)" for c in names)
    long = f.select(LABEL, F.expr(f"stack({len(names)}, {pairs}) AS (feature, value)"))
    alone = MT.auc(long, LABEL, "value", ["feature"], scan.value_bounds(long, ["value"])["value"]).select("feature", "auc")
    coef = M.coefficient_table(spark, W.MODEL).select("feature", "coefficient", "odds_ratio")
    return RD.strength_table(coef, alone, RD.vif(f, names))


# ---- samples --------------------------------------------------------------------

SIZES = {"fails": 8, "no_history": 8, "no_odometer": 7, "long_gap": 7, "rare_make": 6, "retest": 7, "random": 7}


def feature_pools():
    """The pools that features alone decide."""
    return {"fails": F.col("n_prior_fails") >= 2, "no_history": F.col("n_prior_fails").isNull(),
            "no_odometer": F.col("prev_odometer").isNull() & F.col("n_prior_fails").isNotNull(),
            "long_gap": F.col("days_since_prev") > 450,
            "rare_make": ~F.col("make").isin("FURNITURE", "MACHINERY", "BUILDING")}


@query
def sample_pools(spark, sf):
    s = W.SETTINGS
    repeats = H.has_repeat(W.events(spark, sf), s.gap_days).withColumn("__repeat", F.lit(True))
    f = W.features(spark, sf).join(repeats, "registration", "left")
    pools = {**feature_pools(), "retest": F.col("__repeat"), "random": F.lit(True)}
    return SP.sample_pools(f, pools, SIZES, "registration", "mot_test_number").select(
        "pool", "registration", "mot_test_number", "test_date", "make")


@query
def simple_sample(spark, sf):
    return SP.simple_sample(W.features(spark, sf), "mot_test_number", 400).select("mot_test_number", "registration", "test_date")


@query
def repeat_entities(spark, sf):
    return H.has_repeat(W.events(spark, sf), W.SETTINGS.gap_days)


@query
def data_checks(spark, sf):
    f = W.features(spark, sf)
    return Q.check_table(f, {
        "outcome is 0 or 1": F.col(LABEL).isin(0, 1), "history is consistent":
            (F.col("n_prior_cycles") == 0) == F.col("n_prior_fails").isNull(),
        "gap respected": F.coalesce(F.col("days_since_prev") > W.SETTINGS.gap_days, F.lit(True)),
        "odometer known": F.col("prev_odometer").isNotNull()})


# ---- nested records ----------------------------------------------------------------

def documents(spark, sf):
    return RC.export_records(W.entities(spark, sf), W.events(spark, sf), W.items(spark, sf))


def documents_of(spark, sf):
    """Builds the documents of at most n listed entities."""
    return lambda keys, n: RC.export_records(*RC.of_entities(W.entities(spark, sf), W.events(spark, sf), W.items(spark, sf), keys, n))


@query
def nested_history_export(spark, sf):
    """S9, flattened to one row per document with totals that pin its content."""
    return documents(spark, sf).select(
        "registration", "make", "firstUsedDate", "registrationDate", "part", "n_parts",
        F.size("motTests").alias("n_tests"),
        F.aggregate("motTests", F.lit(0), lambda a, t: a + F.size(t["defects"])).alias("n_defects"),
        F.aggregate("motTests", F.lit(0), lambda a, t: a + F.size(F.filter(t["defects"], lambda d: d["dangerous"])))
         .alias("n_dangerous"),
        F.try_element_at("motTests", F.lit(1))["motTestNumber"].alias("first_test"),
        F.try_element_at("motTests", F.lit(-1))["completedDate"].alias("last_completed"))


@query
def nested_features(spark, sf):
    dates = W.features(spark, sf).select("registration", "test_date")
    return N.features_at(documents(spark, sf), dates, W.SETTINGS)


@query
def parity_mismatches(spark, sf):
    """Relational against nested features, probability and band of every cycle, by field."""
    f = M.scored(W.features(spark, sf), W.MODEL)
    got = N.features_at(documents(spark, sf), f.select("registration", "test_date"), W.SETTINGS) \
        .join(W.entities(spark, sf).select("registration", R.clean_label("make", W.SCOPE).alias("make")), "registration")
    fields = [*M.NUMERIC, "make", "p", "band"]
    checks = N.parity(f, M.scored(got, W.MODEL), ["registration", "test_date"], fields,
                      {"age_years": 0.0101, "p": 1e-4})
    return checks.groupBy("field").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("mismatches"))


RECORD_MODEL = with_provenance(W.MODEL, W.SCOPE, {}, "fixed", "fixed", "", built="2000-01-01")
TODAY = "1999-06-01"


def dated(scores):
    """Scores with the texts as they are given; only the build's version is left to its own query."""
    return scores.drop("model_version")


@query
def record_scores(spark, sf):
    return dated(N.score_records(documents(spark, sf), W.MODEL, W.SETTINGS, F.lit(TODAY).cast("date"), W.SCOPE))


def documents_in_parts(spark, sf):
    """Limits so low that the given entities become documents in parts."""
    return RC.export_records(W.entities(spark, sf), W.events(spark, sf), W.items(spark, sf), max_tests=6, max_items=4, max_document_items=30)


def through_json(spark, docs, name):
    folder = shared_folder(spark, name)
    RC.write_records(docs, f"{folder}/in")
    return folder


@query
def nested_history_parts(spark, sf):
    """Documents in parts through JSON and back, one row per item (or event without items)."""
    folder = through_json(spark, documents_in_parts(spark, sf), "parts")
    back = RC.read_records(spark, f"{folder}/in").where((F.col("n_parts") == 1) | (F.size("motTests") > 0)) \
        .select("registration", "make", "model", F.explode_outer("motTests").alias("t"))   # a part may be empty
    return back.select("registration", "make", "model", "t.*").withColumn("d", F.explode_outer("defects")).groupBy(
        "registration", "make", "model", "motTestNumber", "testResult", "odometerUnit", "odometerResultType", "expiryDate",
        "dataSource", F.substring("completedDate", 1, 10).alias("completed"), F.col("d.type").alias("type"),
        F.col("d.text").alias("text"), F.col("d.dangerous").alias("dangerous")).agg(F.count("*").alias("copies"))


@query
def record_scores_parts(spark, sf):
    """N4 on documents in parts after a JSON round trip: the same scores as whole documents."""
    folder = through_json(spark, documents_in_parts(spark, sf), "parts")
    return dated(N.score_records(RC.read_records(spark, f"{folder}/in"), RECORD_MODEL, W.SETTINGS, F.lit(TODAY).cast("date")))


@query
def stream_score(spark, sf):
    """ST1: all documents, most of them in parts, written as JSON lines, read as a stream, scored, read back."""
    folder = through_json(spark, documents_in_parts(spark, sf), "records")
    stream = RC.read_records(spark, f"{folder}/in", stream=True)
    return dated(jobs.score_to_table(spark, stream, RECORD_MODEL, W.SETTINGS, F.lit(TODAY).cast("date"), folder))


@query
def parity_cases(spark, sf):
    """Cases of five pools written, read back and computed anew from their records."""
    pools, folder = feature_pools(), shared_folder(spark, "cases")
    cases = parity.build_cases(M.scored(W.features(spark, sf), W.MODEL), documents_of(spark, sf), pools, {p: SIZES[p] for p in pools})
    RC.write_cases(cases, folder)
    checks = parity.check_cases(RC.read_cases(spark, folder), W.MODEL, W.SETTINGS)
    return checks.groupBy("group", "registration", "target_date").agg(F.count_if(~F.col("ok")).alias("mismatches"))


# ---- files ----------------------------------------------------------------------

@query
def features_csv(spark, sf):
    """The feature table as CSV and back, and by year as Parquet and back; rows that both have."""
    folder = shared_folder(spark, "features")
    f = durable(W.features(spark, sf))
    TB.write_features_csv(f, f"{folder}/csv")
    TB.write_features(f, f"{folder}/parquet")
    text = TB.read_features_csv(spark, f"{folder}/csv")
    return text.intersect(spark.read.parquet(f"{folder}/parquet").select(*text.columns))


@query
def model_file(spark, sf):
    """The model with its provenance as a file, read back and applied."""
    folder = shared_folder(spark, "model")
    MF.save_model(spark, RECORD_MODEL, folder)
    back = MF.load_model(spark, folder)
    f = W.features(spark, sf)
    return f.select("mot_test_number", M.raw_logit(back).alias("z"), F.lit(back["version"]).alias("version"),
                    F.lit(back["built"]).alias("built"), F.lit(len(back["vehicle_rules"]["make_merges"])).alias("merges"))


@query
def chart_file(spark, sf):
    """The chart's JSON document, read back to points."""
    folder = shared_folder(spark, "chart")
    points = chart.chart_points(W.entities(spark, sf), W.events(spark, sf), W.SETTINGS)
    RC.chart_document(points, W.SETTINGS.generation_order, {"source": F.lit("given")}).write.text(folder)
    shape = "series array<struct<generation string, points array<struct<age bigint, tests bigint, fails bigint, fail_pct double, ci_low double, ci_high double>>>>"
    series = spark.read.text(folder).select(F.explode(F.from_json("value", shape)["series"]).alias("s"))
    return series.select("s.generation", F.explode("s.points").alias("p")).select("generation", "p.*")


@query
def report_file(spark, sf):
    """A sorted report as CSV; the line numbers show the order on disk."""
    folder = shared_folder(spark, "report")
    counts = W.scored(spark, sf).groupBy("make", "band").agg(F.count("*").alias("n"))
    TB.write_report(counts, folder, ["make", BD.order_of("band", M.BANDS)])
    lines = spark.read.option("header", True).schema("make string, band string, n bigint").csv(folder)
    return lines.withColumn("line", F.monotonically_increasing_id() + 1)    # one part: file order


@query
def sql_functions(spark, sf):
    """2.15: the rules as SQL functions over the parts."""
    TB.register_functions(spark, W.PART_SCOPE, 20)
    W.table(spark, sf, "part").createOrReplaceTempView("given_part")
    return TB.query(spark, """SELECT p_partkey, clean_make(concat('  ', lower(p_type), ' ')) AS make,
        in_scope(concat('  ', lower(p_type), ' '), p_name) AS in_scope FROM given_part WHERE p_partkey >= :first""", first=0)


@query
def fit_two_features(spark, sf):
    """M6: an unpenalised fit on two counts, applied to each pair of their values."""
    f = durable(W.features(spark, sf).select(F.coalesce("fails_last_3", F.lit(0)).alias("recent"),
                                             F.coalesce("prev_advisories", F.lit(0)).alias("notes"), LABEL))
    slopes, intercept = M.fit_logistic(f, ["recent", "notes"], LABEL, c=1e6)
    z = F.lit(intercept) + F.lit(slopes[0]) * F.col("recent") + F.lit(slopes[1]) * F.col("notes")
    return f.groupBy("recent", "notes").agg(F.count("*").alias("n")).select("recent", "notes", "n", F.round(sigmoid(z), 4).alias("fitted_rate"))


# ---- streams --------------------------------------------------------------------

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query
def batch_session_cycles(spark, sf):
    return SC.batch_cycles(W.table(spark, sf, "events"), "user_id", "ts", (F.col("event_type") == "error").cast("int"), "event_id", 12 * 3600)


@query
def stream_session_cycles(spark, sf):
    """ST2: the given event table as a stream; only sessions the watermark has closed are final."""
    stream = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf) \
        .withColumn("ts", F.col("ts").cast("timestamp"))   # a watermark needs an instant
    cycles = SC.session_cycles(stream, "user_id", "ts", (F.col("event_type") == "error").cast("int"), "event_id",
                               STREAM_GAP, STREAM_DELAY)
    out = jobs.run_to_table(spark, cycles, "sessions")
    return out.withColumn("first_ts", F.col("first_ts").cast("timestamp_ntz")) \
        .withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


# ---- models ---------------------------------------------------------------------

@query
def fit_logistic(spark, sf):
    train = W.scored(spark, sf).where("split = 'train'")
    model = M.fit_model(durable(train), LABEL, n_makes=4)
    return M.coefficient_table(spark, model)


@query
def platt(spark, sf):
    s = durable(W.scored(spark, sf).where("split <> 'train'").select("mot_test_number", "split", "p", LABEL))
    calibrated = M.platt_of_probability(s.where("split = 'validation'"), "p", LABEL)
    return s.where("split = 'test'").select("mot_test_number", F.round(calibrated(F.col("p")), 4).alias("p_calibrated"))


@query
def fit_one_feature(spark, sf):
    """M6: a plain fit on one count, applied to each of its values."""
    f = durable(W.features(spark, sf).select(F.coalesce("fails_last_3", F.lit(0)).alias("recent"), LABEL))
    (slope,), intercept = M.fit_logistic(f, ["recent"], LABEL, c=1e6)
    return f.groupBy("recent").agg(F.count("*").alias("n")).select(
        "recent", "n", F.round(sigmoid(F.lit(intercept) + F.lit(slope) * F.col("recent")), 4).alias("fitted_rate"))


@query
def train_scores(spark, sf):
    return training.train(W.features(spark, sf), W.SETTINGS, W.SCOPE, n_makes=4).scores


@query
def validation_gates(spark, sf):
    return training.validate(W.features(spark, sf), W.MODEL, W.SETTINGS)["gates"]


@query
def bootstrap_auc(spark, sf):
    f = W.scored(spark, sf).withColumn("age_key", BD.age_key("age_years"))
    rows = RP.rate_lookup(f.where("split = 'train'"), f.where("split = 'test'"), "age_key", LABEL)
    return RS.bootstrap_interval(RS.bootstrap_auc(rows, "mot_test_number", LABEL, ["p", "p_base"], 200))


@query
def permutation_importance(spark, sf):
    f = durable(W.features(spark, sf).select("mot_test_number", LABEL, "make", *[F.col(c).cast("double").alias(c) for c in M.NUMERIC]))
    score = lambda df: df.withColumn("score", F.round(M.probability(W.MODEL), 12))
    return RS.permutation_importance(f, "mot_test_number", LABEL, [*M.NUMERIC, "make"], score)


@query
def pilot_reference_scores(spark, sf):
    """The pilot's grid without its boosters, which SQL can follow."""
    return pilot.compare(W.text_features(spark, sf), W.SETTINGS, fuels=PILOT_FUELS, boost=False)["scores"]


@query
def refit_check(spark, sf):
    """A model written, read back and fitted anew from the same rows; the largest difference of a coefficient."""
    train, folder = durable(W.scored(spark, sf).where("split = 'train'")), shared_folder(spark, "refit")
    MF.save_model(spark, with_provenance(M.fit_model(train, LABEL, n_makes=4), W.SCOPE, {}, "refit", "1", "", built="2000-01-01"), folder)
    saved = MF.load_model(spark, folder)
    apart = M.refit_difference(saved, M.fit_model(train.repartition(3), LABEL, n_makes=4))
    return train.agg(F.count("*").alias("rows_fitted")).select("rows_fitted", F.lit(len(saved["columns"])).alias("columns"), F.lit(apart < 1e-6).alias("same"))


@query
def report_lines(spark, sf):
    """The validation report as ordered lines, read back from its text file."""
    result, folder = training.validate(W.features(spark, sf), W.MODEL, W.SETTINGS), shared_folder(spark, "lines")
    TB.write_lines(training.report_lines(result), folder)
    return spark.read.text(folder).select((F.monotonically_increasing_id() + 1).alias("line"), F.col("value").alias("text"))


@query
def non_empty_checks(spark, sf):
    """The writers refuse an empty table, and pass others through."""
    f = durable(W.features(spark, sf))
    rows = [("features", f), ("features of no make", f.where("make = 'NO SUCH MAKE'"))]
    folder = shared_folder(spark, "checked")
    out = []
    for k, (name, df) in enumerate(rows):
        try:
            TB.write_features(df, f"{folder}/{k}")
            out.append(f.limit(1).select(F.lit(name).alias("table"), F.lit(True).alias("written"), F.lit(spark.read.parquet(f"{folder}/{k}").count()).alias("n")))
        except Q.EmptyTable:
            out.append(f.limit(1).select(F.lit(name).alias("table"), F.lit(False).alias("written"), F.lit(df.count()).alias("n")))
    return out[0].union(out[1])


PILOT_FUELS = ("NATION_0", "NATION_1", "NATION_2")


@query
def pilot_scores(spark, sf):
    result = pilot.compare(W.text_features(spark, sf), W.SETTINGS, fuels=PILOT_FUELS)
    return result["scores"]
