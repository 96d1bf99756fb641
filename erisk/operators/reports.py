"""Rate tables, pivots, lookups, peer ranks and odds."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from erisk.functions.bands import AGE_KEYS, order_of
from erisk.functions.stats import odds, wilson
from erisk.operators import scan
from erisk.operators.metrics import auc_from_cells


def rate_by(df: DataFrame, keys, label: str, min_size: int | None = None) -> DataFrame:
    """Count, fails and rate per key; small groups can be left out."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(label).alias("fails"))
    out = out.withColumn("fail_rate", F.col("fails") / F.col("n"))
    return out if min_size is None else out.where(F.col("n") >= min_size)


def chart_points(first_events: DataFrame, generation: Column, min_age: int, min_size: int) -> DataFrame:
    """Fail percent with its Wilson interval per generation and age."""
    points = (first_events.where(F.col("age") >= min_age)
              .groupBy(generation.alias("generation"), "age")
              .agg(F.count("*").alias("tests"), F.sum("failed").alias("fails"))
              .where(F.col("tests") >= min_size))
    low, high = wilson(F.col("fails"), F.col("tests"))
    return points.select("generation", "age", "tests", "fails",
                         F.round(F.col("fails") * 100 / F.col("tests"), 1).alias("fail_pct"),
                         low.alias("ci_low"), high.alias("ci_high"))


def totals(df: DataFrame, label: str, entity: str, history: str) -> DataFrame:
    """Rows, distinct entities, fails and the share without history."""
    return df.agg(F.count("*").alias("n"), F.count_distinct(entity).alias("entities"), F.sum(label).alias("fails"),
                  F.count_if(F.col(history).isNull()).alias("n_no_history")) \
        .withColumn("fail_pct", F.col("fails") * 100 / F.col("n")) \
        .withColumn("no_history_pct", F.col("n_no_history") * 100 / F.col("n"))


def top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    """The most frequent values with their share; ties by name."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return (counts.select(column, "n", (F.col("n") * 100 / total).alias("share_pct"))
            .orderBy(F.desc("n"), column).limit(k))


def rate_pivot(df: DataFrame, row: Column, rows, column: Column, columns, label: str) -> DataFrame:
    """A10: two-way mean table in percent with every listed row band, empty cells NULL."""
    table = (df.select(row.alias("row_band"), column.alias("col_band"), label)
             .groupBy("row_band").pivot("col_band", list(columns)).agg(F.avg(label) * 100))
    bands = df.sparkSession.createDataFrame([(r,) for r in rows], "row_band string")
    return bands.join(table, "row_band", "left")


def baseline_rates(train: DataFrame, cell_keys, group_key: str, label: str, min_size: int):
    """Cell rates with enough rows, group rates and the overall rate, all from train."""
    by_cell = rate_by(train, cell_keys, label, min_size).select(*cell_keys, F.col("fail_rate").alias("__cell"))
    by_group = rate_by(train, [group_key], label).select(group_key, F.col("fail_rate").alias("__group"))
    overall = train.agg(F.avg(label).alias("__all"))
    return by_cell, by_group, overall


def baseline_predict(train: DataFrame, rows: DataFrame, cell_keys, group_key: str, label: str, min_size: int,
                     low=0.01, high=0.99, out="p_base") -> DataFrame:
    """Cell rate, else group rate, else overall rate, kept inside [low, high].

    Cells are usually few (generation and whole year of age); whether the rates are broadcast is left to their
    measured size.
    """
    by_cell, by_group, overall = baseline_rates(train, cell_keys, group_key, label, min_size)
    joined = rows.join(by_cell, list(cell_keys), "left").join(by_group, group_key, "left")
    rate = F.coalesce(F.col("__cell"), F.col("__group"), overall.scalar())
    return joined.withColumn(out, F.greatest(F.least(rate, F.lit(high)), F.lit(low))).drop("__cell", "__group")


def rate_lookup(train: DataFrame, rows: DataFrame, key: str, label: str, out="p_base", domain=AGE_KEYS) -> DataFrame:
    """One rate per key from train, the overall train rate where the key is new.

    A key with a fixed ``domain`` has a bounded rate table, which is broadcast; without one
    (``domain=None``) the join strategy is Spark's.
    """
    rates = rate_by(train, [key], label).select(key, F.col("fail_rate").alias("__rate"))
    if domain is not None:
        rates = F.broadcast(rates.where(F.col(key).isin(*domain)))
    overall = train.agg(F.avg(label).alias("__all"))
    return (rows.join(rates, key, "left")
            .withColumn(out, F.coalesce(F.col("__rate"), overall.scalar())).drop("__rate"))


# ---- peers --------------------------------------------------------------------

def peer_cells(df: DataFrame, group: str, value: str, label: str) -> DataFrame:
    """Percent rank (average rank / group size) of each distinct value inside its peer group."""
    cell_df = scan.cells(df, [group], value, {"n": F.lit(1), "fails": F.col(label)})
    run = scan.running(cell_df, [group], value, ["n"])
    rank = F.col("before_n") + (F.col("n") + 1) / 2
    return run.select(group, value, "n", "fails", (rank * 100 / F.col("total_n")).alias("peer_pct"))


def peer_ranked(df: DataFrame, group: str, value: str, label: str) -> DataFrame:
    """W14 on rows: every row with its peer percent rank (skewed cells are split by the adaptive join)."""
    ranked = peer_cells(df, group, value, label).drop("n", "fails")
    return scan.join_same(df, ranked, [group, value], "left")


def rate_by_band(cell_df: DataFrame, band: Column) -> DataFrame:
    """A30 from cells: cars, fails and rate per band."""
    return (cell_df.groupBy(band.alias("band")).agg(F.sum("n").alias("n"), F.sum("fails").alias("fails"))
            .withColumn("fail_rate", F.col("fails") / F.col("n")))


def bands_in_order(rates: DataFrame, order) -> DataFrame:
    """Do the rates rise along the order? Bands are a handful of rows."""
    cols = [F.max(F.when(F.col("band") == b, F.col("fail_rate"))).alias(f"__r{i}") for i, b in enumerate(order)]
    row = rates.agg(*cols)
    ok = F.lit(True)
    for i in range(len(order) - 1):
        ok = ok & (F.col(f"__r{i}") < F.col(f"__r{i + 1}"))
    return row.select(F.coalesce(ok, F.lit(False)).alias("rising"))


def band_share(df: DataFrame, group: str, band: str, order, label: str) -> DataFrame:
    """Per peer group its size, and share and rate of each band."""
    counted = df.groupBy(group, band).agg(F.count("*").alias("n"), F.sum(label).alias("fails"))
    cols = [F.sum("n").alias("n")]
    for b in order:
        name = b.lower().replace(" ", "_")
        here = F.col(band) == b
        cols += [(F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)) * 100 / F.sum("n")).alias(f"share_{name}"),
                 (F.sum(F.when(here, F.col("fails"))) * 100 / F.sum(F.when(here, F.col("n")))).alias(f"fail_{name}")]
    return counted.groupBy(group).agg(*cols)


def group_total_lift(df: DataFrame, groups: dict, member: str, band: Column, low: str, high: str,
                     label: str, score: str) -> DataFrame:
    """Rates in the lowest and highest band for members and for their group as a whole.

    Both levels come from one grouping-sets pass over (group, member, band, score) cells; the AUC of
    the single column comes from the same cells.
    """
    group = None
    for g, members in groups.items():
        cond = F.col(member).isin(*members)
        group = F.when(cond, g) if group is None else group.when(cond, g)
    folded = (df.where(F.col(score).isNotNull())
              .select(group.alias("grp"), F.col(member).alias("member"), band.alias("band"), score, label)
              .where(F.col("grp").isNotNull())
              .groupBy("grp", "member", "band", score)
              .agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg")))
    both = folded.groupingSets([["grp", "member", "band", score], ["grp", "band", score]],
                               "grp", "member", "band", score) \
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.grouping("member").alias("__all")) \
        .select("grp", F.when(F.col("__all") == 1, F.concat(F.lit("ALL "), F.col("grp"))).otherwise(F.col("member"))
                .alias("member"), "band", score, "pos", "neg")
    keys = ["grp", "member"]
    bounds = scan.value_bounds(folded, [score])[score]
    ranked = auc_from_cells(
        scan.block_of(both.groupBy(*keys, F.col(score).cast("double").alias(score))
                      .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")),
                      score, bounds), score, keys)
    pct = lambda b: F.sum(F.when(F.col("band") == b, F.col("pos"))) * 100 \
        / F.sum(F.when(F.col("band") == b, F.col("pos") + F.col("neg")))
    rates = both.groupBy(*keys).agg(pct(low).alias("fail_low"), pct(high).alias("fail_high"),
                                    F.sum(F.col("pos") + F.col("neg")).alias("n"))
    return rates.join(ranked.select(*keys, "auc"), keys).select(
        *keys, "fail_low", "fail_high", (F.col("fail_high") - F.col("fail_low")).alias("lift_points"), "auc", "n")


def raw_and_model_odds(df: DataFrame, group: str, reference: str, label: str, age: str, model_odds: dict) -> DataFrame:
    """Size, share, mean age, rate and odds ratio against the reference group, beside the model's."""
    g = df.groupBy(group).agg(F.avg(label).alias("fail_rate"), F.count("*").alias("n"), F.avg(age).alias("mean_age"))
    ref = g.where(F.col(group) == reference).agg(F.max("fail_rate")).scalar()
    total = g.agg(F.sum("n")).scalar()
    known = F.create_map(*[x for k, v in model_odds.items() for x in (F.lit(k), F.lit(float(v)))])
    lookup = F.coalesce(F.try_element_at(known, F.col(group)), F.lit(1.0))
    return g.select(
        group, "n", (F.col("n") * 100 / total).alias("share_pct"), "mean_age", "fail_rate",
        F.try_divide(odds(F.col("fail_rate")), odds(ref)).alias("raw_odds_ratio"),
        lookup.alias("model_odds_ratio"))


def actual_expected(df: DataFrame, group: str, label: str, expected: str) -> DataFrame:
    """Actual rate beside the expected one per group."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.avg(label).alias("actual"),
                                 F.avg(expected).alias("expected"))


def odds_steps(df: DataFrame, key: str, label: str) -> DataFrame:
    """Rate, odds, log-odds and the odds ratio to the previous value. One row per distinct value."""
    table = rate_by(df, [key], label).withColumn("odds", odds(F.col("fail_rate")))
    step = F.try_divide(F.col("odds"), F.lag("odds").over(Window.orderBy(key)))   # grouped table only
    return table.select(key, "n", "fail_rate", "odds", F.ln("odds").alias("log_odds"), step.alias("odds_step"))


def age_lookup(train: DataFrame, test: DataFrame, key: str, label: str, order) -> DataFrame:
    """Train and test sizes and rates side by side, in a fixed key order, gaps in points."""
    a = rate_by(train, [key], label).select(key, F.col("n").alias("train_n"), (F.col("fail_rate") * 100).alias("train_pct"))
    b = rate_by(test, [key], label).select(key, F.col("n").alias("test_n"), (F.col("fail_rate") * 100).alias("test_pct"))
    keys = train.sparkSession.createDataFrame([(k, i) for i, k in enumerate(order, 1)], f"{key} string, position int")
    return (keys.join(a.join(b, key, "full_outer"), key, "left")
            .withColumn("gap_points", F.col("train_pct") - F.col("test_pct")))


def labels_per_group(df: DataFrame, group: str, item: str, order) -> DataFrame:
    """The distinct labels of each group in a fixed order, as one text."""
    ordered = F.array_sort(F.collect_set(F.struct(order_of(item, order).alias("o"), F.col(item).alias("v"))))
    distinct = df.select(group, item).distinct()   # bounded by the label domain
    return distinct.groupBy(group).agg(F.array_join(F.transform(ordered, lambda s: s["v"]), ", ").alias("labels"))


def histogram(df: DataFrame, value: Column, low: float, width: float, flags: dict[str, Column] | None = None) -> DataFrame:
    """Equal-width counts and density, with one extra count per flag."""
    extra = {k: F.count_if(c) for k, c in (flags or {}).items()}
    counted = (df.where(value.isNotNull()).groupBy(F.floor((value - low) / width).cast("long").alias("bucket"))
               .agg(F.count("*").alias("n"), *[c.alias(k) for k, c in extra.items()]))
    total = counted.agg(F.sum("n")).scalar()
    return counted.select("bucket", (F.col("bucket") * width + low).alias("from_value"), "n",
                          (F.col("n") / total / width).alias("density"), *extra)


def missing_patterns(df: DataFrame, key: str, others, single: str) -> DataFrame:
    """Rows with the key blank, with all blank, and with only one column blank."""
    every = F.col(key).isNull()
    for c in others:
        every = every & F.col(c).isNull()
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("key_blank"),
                  F.count_if(every).alias("all_blank"),
                  F.count_if(F.col(single).isNull() & F.col(key).isNotNull()).alias("only_single_blank"))


def split_ranges(df: DataFrame, split: str, date: str) -> DataFrame:
    """A38."""
    return df.groupBy(split).agg(F.count("*").alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
