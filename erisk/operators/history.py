"""Event histories: population, repeat removal, as-of features.

Skew: one entity, or one event, may hold a third of all rows.
* Items are counted per event with a plain partial aggregation, before any join.
* Events are cut to the first one of each (entity, day); Spark applies that rank limit before the
  shuffle too, so a hot entity ships at most its days. From there an entity has no more rows than
  the calendar has days, and after gap removal no more than days / gap: every later window is
  bounded by the date span, not by the data.
* Entity attributes are joined last, on the key the windows are already partitioned by.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from erisk.functions import rules as R, text as T
from erisk.settings import ScopeRules, Settings, TextRules

ENTITY, EVENT = "registration", "mot_test_number"
COUNTED = ("n_advisory", "n_fail_items")


# ---- population ---------------------------------------------------------------

def day_column(events: DataFrame) -> Column:
    kind = dict(events.dtypes)["completed_date"]
    return F.to_date("completed_date") if kind.startswith("timestamp") else R.day("completed_date")


def in_dates(events: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Inclusive days, None for an open end; events without a day are left out. On a timestamp the limits are
    put on the column itself, so they reach the scan."""
    kind = dict(events.dtypes)["completed_date"]
    stamped = kind.startswith("timestamp")
    at = F.col("completed_date") if stamped else R.day("completed_date")
    limit = lambda text, days: (lambda d: d.cast(kind) if stamped else d)(F.date_add(F.lit(text).cast("date"), days))
    out = events.where(at.isNotNull())
    if end is not None:
        out = out.where(at < limit(end, 1))
    return out if start is None else out.where(at >= limit(start, 0))


def prepare_events(events: DataFrame, s: Settings, key_filter: Column | None = None,
                   start: str | None = None, also=()) -> DataFrame:
    """pass/fail events of the right source up to the snapshot end (from ``start``), with columns ``also``."""
    result = R.result_text("test_result", s)
    out = in_dates(events.where(result.isin(s.passed, s.failed)), start, s.snapshot_end)
    if s.source is not None:
        out = out.where(R.known_source("data_source", s))
    if key_filter is not None:
        out = out.where(key_filter)
    return out.select(
        ENTITY, EVENT, "completed_date", day_column(events).alias("d"), (result == s.failed).cast("int").alias("failed"),
        R.reading(F.col("odometer_value"), F.col("odometer_unit"), F.col("odometer_result_type"), s.km_factor)
         .alias("miles"), *also)


def prepare_entities(entities: DataFrame, rules: ScopeRules | None = None, sample_pct: int | None = None,
                     member: Column | None = None) -> DataFrame:
    """Entities with a start date, in scope, in the sample."""
    out = entities.where(F.coalesce(F.col("first_used_date"), F.col("registration_date")).isNotNull())
    if member is not None:
        out = out.where(member)
    if sample_pct is not None and sample_pct < 100:
        out = out.where(R.in_sample(ENTITY, sample_pct) == 1)
    if rules is not None:
        out = out.where(R.in_scope("make", "model", rules) == 1)
    make = R.clean_label("make", rules) if rules is not None else F.col("make")
    return out.select(ENTITY, R.start_day().alias("start_date"), make.alias("make"),
                      R.clean_text("fuel_type").alias("fuel_type"), "engine_size")


# ---- repeat removal -----------------------------------------------------------

def first_of_day(events: DataFrame) -> DataFrame:
    """The first event of each entity and day (fail first at one time, then the lowest event id).

    Only this row of a day can start a cycle: any later one has a gap of zero days.
    """
    w = Window.partitionBy(ENTITY, "d").orderBy("completed_date", F.desc("failed"), EVENT)
    return events.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def by_time() -> Window:
    return Window.partitionBy(ENTITY).orderBy("d")


def cycles(daily: DataFrame, gap_days: int) -> DataFrame:
    """Keep an event when the previous one of any kind is more than the gap away."""
    return (daily.withColumn("__prev", F.lag("d").over(by_time()))
                 .where(F.col("__prev").isNull() | (F.datediff("d", "__prev") > gap_days)).drop("__prev"))


def flag_cycles(events: DataFrame, gap_days: int) -> DataFrame:
    """Every event with the days since the previous one and whether it starts a cycle.

    Later events of a day are zero days from the previous one; only first-of-day rows need the window.
    """
    heads = first_of_day(events)
    gaps = heads.select(F.col(EVENT).alias("__head"), F.datediff("d", F.lag("d").over(by_time())).alias("__gap"))
    marked = events.join(gaps, events[EVENT] == gaps["__head"], "left")
    days = F.when(F.col("__head").isNotNull(), F.col("__gap")).otherwise(F.lit(0))
    return (marked.withColumn("days_since_previous", days)
                  .withColumn("kept_as_cycle", (F.col("days_since_previous").isNull()
                                                | (F.col("days_since_previous") > gap_days)).cast("int"))
                  .drop("__head", "__gap"))


# ---- items --------------------------------------------------------------------

def item_counts(items: DataFrame, s: Settings) -> DataFrame:
    """A1: advisories, fail items and minors per event."""
    kind = F.upper("type") if s.fold_result_case else F.col("type")
    return items.groupBy(EVENT).agg(
        F.count_if(kind == s.advisory_type).alias("n_advisory"),
        F.count_if(kind.isin(*s.fail_types)).alias("n_fail_items"),
        F.count_if(kind == s.minor_type).alias("n_minor"))


def item_text_counts(items: DataFrame, s: Settings, rules: TextRules) -> DataFrame:
    """A2: item counts per category, ready for either rule set.

    Which rule applies to coded text depends on the event's day. Rather than join every item to its
    event first, both answers are counted per event; ``choose_text_counts`` picks one after the join.
    """
    lowered = F.col("__text")
    adv = F.col("type") == s.advisory_type
    marked = (items.select(EVENT, "type", "text", F.lower("text").alias("__text"))
              .select(EVENT, "type", adv.alias("__adv"),
                      F.when(adv & ~F.coalesce(T.is_note(lowered, rules), F.lit(False)),
                             F.coalesce(T.is_coded(F.col("text"), rules), F.lit(False))).alias("__coded"),
                      F.when(adv, T.code_category(lowered, rules)).alias("__code"),
                      F.when(adv, T.keyword_category(lowered, rules)).alias("__word"),
                      *[(adv & lowered.contains(p)).alias(f"__flag_{f}") for f, p in rules.flags]))
    counts = []
    for c in rules.categories:
        counts += [F.count_if(F.col("__coded") & (F.col("__code") == c)).alias(f"__code_{c}"),
                   F.count_if(F.col("__coded") & (F.col("__word") == c)).alias(f"__coded_word_{c}"),
                   F.count_if(~F.col("__coded") & (F.col("__word") == c)).alias(f"__word_{c}")]
    return marked.groupBy(EVENT).agg(
        F.count_if("__adv").alias("n_advisory"),
        F.count_if(F.col("type").isin(*s.fail_types)).alias("n_fail_items"),
        F.count_if(F.col("type") == s.minor_type).alias("n_minor"),
        *counts, *[F.count_if(f"__flag_{f}").alias(f"adv_{f}") for f, _ in rules.flags])


def category_totals(items: DataFrame, days: DataFrame, s: Settings, rules: TextRules) -> DataFrame:
    """T5 item by item: type, category and n. Items are counted per event and pair of answers before they meet the event's
    day (``days``: event and ``d``), so an event with any number of items joins as a few rows."""
    answers = T.item_answers(F.col("text"), F.col("type"), s.advisory_type, rules).alias("a")
    counted = items.select(EVENT, "type", answers).groupBy(EVENT, "type", "a").agg(F.count("*").alias("n"))
    since = F.coalesce(F.col("d") >= F.lit(s.regime_date).cast("date"), F.lit(False))
    category = F.when(since, F.col("a.since")).otherwise(F.col("a.before"))
    return counted.join(days, EVENT).groupBy("type", category.alias("category")).agg(F.sum("n").alias("n"))


def choose_text_counts(joined: DataFrame, s: Settings, rules: TextRules) -> DataFrame:
    """T5 after aggregation: code categories from the regime date, keywords before it."""
    coded_ok = F.col("d") >= F.lit(s.regime_date).cast("date")
    chosen = [(F.when(coded_ok, F.col(f"__code_{c}")).otherwise(F.col(f"__coded_word_{c}"))
               + F.col(f"__word_{c}")).alias(f"adv_{c}") for c in rules.categories]
    keep = [c for c in joined.columns if not c.startswith("__")]
    return joined.select(*keep, *chosen)


def with_items(events: DataFrame, counts: DataFrame) -> DataFrame:
    """Events keep their row; no items means 0."""
    names = [c for c in counts.columns if c != EVENT]
    joined = events.join(counts, EVENT, "left")
    return joined.select(*events.columns, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])


# ---- features -----------------------------------------------------------------

def cycle_table(events: DataFrame, items: DataFrame | None, s: Settings, text_rules: TextRules | None = None,
                key_filter: Column | None = None, chosen: bool = False) -> DataFrame:
    """Events -> first of day -> counted items -> cycles. The cut comes first: it shrinks hot entities.

    With a sample or a family (``chosen``) items are cut to the events left before they are classified and counted;
    for the full population that join would cost more than it saves. Without items the events carry their counts.
    """
    if items is None:
        return cycles(first_of_day(prepare_events(events, s, key_filter, also=COUNTED)), s.gap_days)
    daily = first_of_day(prepare_events(events, s, key_filter))
    if chosen or key_filter is not None:
        items = items.join(daily.select(EVENT), EVENT, "left_semi")
    if text_rules is None:
        counted = with_items(daily, item_counts(items, s).drop("n_minor"))
    else:
        counted = choose_text_counts(with_items(daily, item_text_counts(items, s, text_rules)), s, text_rules)
    return cycles(counted, s.gap_days)


def history_columns(s: Settings) -> list[Column]:
    """What was known before each cycle."""
    w = by_time()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last3 = w.rowsBetween(-3, -1)
    prev = lambda c, k=1: F.lag(c, k).over(w)
    return [
        (F.row_number().over(w) - 1).cast("long").alias("n_prior_cycles"),
        F.sum("failed").over(before).alias("n_prior_fails"),
        F.sum("failed").over(last3).alias("fails_last_3"),
        prev("miles").alias("prev_odometer"),
        prev("n_fail_items").alias("prev_fail_items"),
        prev("n_advisory").alias("prev_advisories"),
        F.datediff("d", prev("d")).cast("long").alias("days_since_prev"),
        (prev("miles") - prev("miles", 2)).alias("__miles"),
        F.datediff(prev("d"), prev("d", 2)).alias("__days"),
    ]


def text_history_columns(s: Settings, rules: TextRules) -> list[Column]:
    """W7, W11-W13 and the lagged category counts."""
    w = by_time()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    regime = F.lit(s.regime_date).cast("date")
    prev = lambda c, k=1: F.lag(c, k).over(w)
    both = [((prev(f"adv_{c}") > 0) & (prev(f"adv_{c}", 2) > 0)).cast("int") for c in rules.recurring]
    total = both[0]
    for b in both[1:]:
        total = total + b
    return [
        prev("failed").cast("long").alias("prev_failed"),
        prev("n_minor").alias("prev_minors"),
        *[prev(f"adv_{c}").alias(f"prev_adv_{c}") for c in rules.count_names],
        F.sum(F.when(F.col("d") < regime, F.col("failed")).otherwise(0)).over(before).alias("n_prior_fails_before"),
        F.sum(F.when(F.col("d") >= regime, F.col("failed")).otherwise(0)).over(before).alias("n_prior_fails_since"),
        (prev("d") < regime).cast("long").alias("prev_test_before"),
        (prev("n_advisory") - prev("n_advisory", 2)).alias("advisory_trend"),
        F.when(prev("d", 2).isNotNull(), total).cast("long").alias("n_recurring_categories"),
    ]


def cycle_features(entities: DataFrame, events: DataFrame, items: DataFrame, s: Settings,
                   rules: ScopeRules | None = None, target_start: str | None = None) -> DataFrame:
    """The all-entity feature table: one row per predicted cycle, features from earlier cycles only.

    The hash sample is a property of the key, so it cuts events at the scan, before any shuffle.
    The date filter comes after the windows: earlier cycles are history, not targets (P17).
    """
    key_filter = R.in_sample(ENTITY, s.sample_pct) == 1 if s.sample_pct < 100 else None
    built = cycle_table(events, items, s, key_filter=key_filter).select("*", *history_columns(s))
    wanted = built.where(F.col("d") >= F.lit(target_start or s.regime_date).cast("date"))
    people = prepare_entities(entities, rules, s.sample_pct)
    return wanted.join(people, ENTITY).select(
        ENTITY, EVENT, F.col("d").alias("test_date"), F.col("failed").cast("long").alias("target_failed"),
        "make", "fuel_type", R.age_years(F.col("d"), F.col("start_date")).alias("age_years"),
        "n_prior_cycles", "n_prior_fails", "fails_last_3", "prev_odometer", "prev_fail_items",
        "prev_advisories", "days_since_prev",
        R.annual_rate(F.col("__miles"), F.col("__days")).alias("annual_miles_last_interval"))


def cycle_features_text(entities: DataFrame, events: DataFrame, items: DataFrame, s: Settings,
                        text_rules: TextRules, member: Column | None = None,
                        target_start: str | None = None, leaky: bool = False) -> DataFrame:
    """The one-family feature table with text-derived features.

    With ``member`` (a selective family) events are cut to it by a semi-join before the shuffles.
    ``leaky=True`` adds the older reading-at-the-target columns (P34), which no model should use.
    """
    people = prepare_entities(entities, member=member)
    chosen = events if member is None else events.join(people.select(ENTITY), ENTITY, "left_semi")
    extra = [(F.col("miles") - F.lag("miles").over(by_time())).alias("__since")] if leaky else []
    built = cycle_table(chosen, items, s, text_rules, chosen=member is not None).select(
        "*", *history_columns(s), *text_history_columns(s, text_rules), *extra)
    wanted = built.where(F.col("d") >= F.lit(target_start or s.regime_date).cast("date"))
    annual = R.annual_rate(F.col("__miles"), F.col("__days"))
    out = wanted.join(people, ENTITY).select(
        ENTITY, EVENT, F.col("d").alias("test_date"), F.col("failed").cast("long").alias("target_failed"),
        "fuel_type", "engine_size", F.year("start_date").cast("long").alias("reg_year"),
        R.age_years(F.col("d"), F.col("start_date")).alias("age_years"),
        "n_prior_cycles", "n_prior_fails", "prev_failed", "prev_advisories", "prev_fail_items", "prev_minors",
        *[f"prev_adv_{c}" for c in text_rules.count_names],
        "days_since_prev", "prev_odometer", "fails_last_3", "n_prior_fails_before", "n_prior_fails_since",
        "prev_test_before", "advisory_trend", "n_recurring_categories",
        annual.alias("annual_miles_last_interval"),
        R.projected(F.col("prev_odometer"), annual, F.col("days_since_prev")).alias("projected_miles"),
        *([F.when(F.col("__since") >= 0, F.col("__since")).alias("miles_since_prev")] if leaky else []))
    if leaky:
        out = out.withColumn("miles_per_year", R.annual_rate(F.col("miles_since_prev"), F.col("days_since_prev")))
    return out


# ---- other questions about histories -------------------------------------------

def history_of(events: DataFrame, keys: DataFrame) -> DataFrame:
    """The raw events of the listed entities, one semi-join for any number of keys."""
    return events.join(keys.select(ENTITY).distinct(), ENTITY, "left_semi")


def first_per_age_year(entities: DataFrame, events: DataFrame, s: Settings, start: str) -> DataFrame:
    """The first event of each entity and year of age; a different rule from ``cycles``."""
    daily = first_of_day(prepare_events(events, s, start=start))
    joined = daily.join(entities.select(ENTITY, "start_date"), ENTITY).select(
        ENTITY, EVENT, "completed_date", "failed", F.year("start_date").alias("reg_year"),
        R.age_rounded(F.col("d"), F.col("start_date")).alias("age"))
    w = Window.partitionBy(ENTITY, "age").orderBy("completed_date", F.desc("failed"), EVENT)
    return joined.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def has_repeat(events: DataFrame, gap_days: int) -> DataFrame:
    """Entities with any two consecutive raw events within the gap (same-day ones included)."""
    days = events.select(ENTITY, day_column(events).alias("d")).groupBy(ENTITY, "d").agg(F.count("*").alias("n"))
    near = (F.col("n") > 1) | (F.datediff("d", F.lag("d").over(by_time())) <= gap_days)
    return (days.select(ENTITY, near.alias("near")).where("near").select(ENTITY).distinct())


def rule_agreement(events: DataFrame, items: DataFrame, s: Settings, rules: TextRules,
                   entities: DataFrame | None = None) -> DataFrame:
    """How often the keyword category equals the code category, by pair.

    Items are counted per (event, code, keyword) first, so the join sees a few rows an event.
    """
    lowered = F.col("__text")
    pairs = (items.where(F.col("type") == s.advisory_type)
             .select(EVENT, "text", F.lower("text").alias("__text"))
             .where(T.is_coded(F.col("text"), rules) & ~T.is_note(lowered, rules))
             .select(EVENT, T.code_category(lowered, rules).alias("code_cat"),
                     T.keyword_category(lowered, rules).alias("keyword_cat"))
             .groupBy(EVENT, "code_cat", "keyword_cat").agg(F.count("*").alias("n")))
    population = prepare_events(events, s, start=s.regime_date)
    if entities is not None:
        population = population.join(entities.select(ENTITY), ENTITY, "left_semi")
    return (pairs.join(population.select(EVENT), EVENT)
                 .groupBy("code_cat", "keyword_cat").agg(F.sum("n").alias("n")))


def agreement_by_code(pairs: DataFrame) -> DataFrame:
    """Total and agreeing share per code category, plus an ALL row."""
    return (pairs.rollup("code_cat").agg(
                F.sum("n").alias("n"),
                F.sum(F.when(F.col("code_cat") == F.col("keyword_cat"), F.col("n")).otherwise(0)).alias("n_agree"),
                F.grouping("code_cat").alias("__all"))
            .select(F.when(F.col("__all") == 1, "ALL").otherwise(F.col("code_cat")).alias("code_cat"),
                    "n", "n_agree", (F.col("n_agree") * 100 / F.col("n")).alias("agree_pct")))


def top_disagreements(pairs: DataFrame, k: int = 5) -> DataFrame:
    """O3."""
    return (pairs.where(F.col("code_cat") != F.col("keyword_cat"))
                 .orderBy(F.desc("n"), "code_cat", "keyword_cat").limit(k))


def safety_net(entities: DataFrame, events: DataFrame, s: Settings, rules: ScopeRules, known,
               small: float = 900, min_size: int = 20, share: float = 0.2) -> DataFrame:
    """Labels with many small engines among entities tested in the window."""
    dated = in_dates(events, s.regime_date, s.snapshot_end)
    seen = (dated if s.source is None else dated.where(R.known_source("data_source", s))).select(ENTITY).distinct()
    covered = entities.where((R.in_sample(ENTITY, s.sample_pct) == 1) & (R.in_scope("make", "model", rules) == 1))
    grouped = (covered.join(seen, ENTITY, "left_semi")
               .groupBy(R.clean_label("make", rules).alias("make"))
               .agg(F.count("*").alias("vehicles"), F.count_if(F.col("engine_size") < small).alias("under_limit"))
               .where(F.col("vehicles") >= min_size))
    pct = F.col("under_limit") * 100 / F.col("vehicles")
    return (grouped.withColumn("under_pct", pct)
            .withColumn("flagged", (F.col("under_limit") / F.col("vehicles") > share).cast("int"))
            .withColumn("note", F.when(F.col("flagged") == 0, "")
                        .when(F.col("make").isin(*known), "known small cars").otherwise("CHECK")))
