"""Learn bins on train, apply them anywhere; WoE, IV, PSI, AUC, monotonicity.

All features are handled at once. Rows are unpivoted and folded to cells of
(feature, value, split, year) with counts; every statistic below reads those cells, so the data is
scanned once however many features and statistics are asked for.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from erisk.operators import metrics, scan

MISSING, UNSEEN = "missing", "other (unseen in train)"
# Binning and gate thresholds.
N_BINS, MAX_DISCRETE, MAX_COUNT_DISTINCT = 10, 12, 40
MIN_BIN_SHARE, SMOOTH, MONO_MIN_N = 0.02, 0.5, 100


def feature_cells(df: DataFrame, numeric, categorical, label: str, split: str, year: str) -> DataFrame:
    """(feature, value, text, split, year) -> n, fails. NULL values form a cell of their own."""
    parts = [f"'{c}', CAST(`{c}` AS DOUBLE), CAST(NULL AS STRING)" for c in numeric] + \
            [f"'{c}', CAST(NULL AS DOUBLE), CAST(`{c}` AS STRING)" for c in categorical]
    long = df.select(F.col(split).alias("split"), F.col(year).alias("year"), F.col(label).alias("__y"),
                     F.expr(f"stack({len(parts)}, {', '.join(parts)}) AS (feature, value, text)"))
    return long.groupBy("feature", "value", "text", "split", "year").agg(
        F.count("*").alias("n"), F.sum("__y").alias("fails"))


@dataclass(frozen=True)
class BinRules:
    """What was learnt on train: at most a few dozen numbers per feature."""

    edges: dict = field(default_factory=dict)     # continuous: inner edges
    caps: dict = field(default_factory=dict)      # counts: (cap, has_tail)
    categories: tuple = ()


def profile(cell_df: DataFrame) -> DataFrame:
    """A25 per feature: rows, missing percent, min, max, distinct, all whole numbers."""
    known = F.col("value").isNotNull() | F.col("text").isNotNull()
    per_value = cell_df.groupBy("feature", "value", "text").agg(F.sum("n").alias("n"))
    return per_value.groupBy("feature").agg(
        F.sum("n").alias("n"), (F.sum(F.when(known, 0).otherwise(F.col("n"))) * 100 / F.sum("n")).alias("missing_pct"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.count_if(known).alias("distinct_values"),
        F.coalesce(F.bool_and(F.col("value") == F.floor("value")), F.lit(False)).alias("all_whole"))


def value_tails(cell_df: DataFrame) -> DataFrame:
    """Rows at or above each value, for features already known to have few values."""
    per_value = cell_df.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("feature").orderBy(F.desc("value"))
    return per_value.select("feature", "value", "n", F.sum("n").over(down).alias("tail"),
                            F.sum("n").over(Window.partitionBy("feature")).alias("present"))


def learn(cell_df: DataFrame, numeric, categorical, split: str = "train", bins: int = N_BINS) -> BinRules:
    """Decile edges, or one bin per value with the rare upper tail grouped."""
    train = cell_df.where((F.col("split") == split) & F.col("feature").isin(*numeric))
    shape = {r["feature"]: r for r in profile(train).collect()}   # one row per feature
    counts = [f for f in numeric if f in shape and (
        shape[f]["distinct_values"] <= MAX_DISCRETE
        or (shape[f]["all_whole"] and shape[f]["distinct_values"] <= MAX_COUNT_DISTINCT))]
    smooth = [f for f in numeric if f in shape and f not in counts]
    caps = {}
    if counts:
        tails = value_tails(train.where(F.col("feature").isin(*counts)))
        for r in tails.groupBy("feature").agg(
                F.max(F.when(F.col("tail") >= MIN_BIN_SHARE * F.col("present"), F.col("value"))).alias("cap"),
                F.max("value").alias("top")).collect():
            cap = r["top"] if r["cap"] is None else r["cap"]
            caps[r["feature"]] = (cap, r["top"] > cap)
    edges = {}
    if smooth:
        part = train.where(F.col("feature").isin(*smooth))
        bounds = scan.value_bounds(part, ["value"])["value"]
        probs = [i / bins for i in range(bins + 1)]
        found = {}
        for r in scan.quantiles(part, "value", probs, ["feature"], bounds, weight=F.col("n")).collect():
            found.setdefault(r["feature"], set()).add(r["quantile"])
        edges = {f: sorted(q)[1:-1] for f, q in found.items()}
    return BinRules(edges, caps, tuple(categorical))


def show(v: float) -> str:
    return str(int(v)) if float(v).is_integer() else str(v)


def edge_labels(edges) -> list[str]:
    ends = ["-inf", *[f"{e:.10g}" for e in edges], "inf"]
    return [f"({a}, {b}]" for a, b in zip(ends, ends[1:])]


def number_bin(feature: str, value: Column, rules: BinRules) -> Column:
    """The bin label of a numeric value under the learnt rules (any split, rows or cells)."""
    out = F.when(value.isNull(), MISSING)
    if feature in rules.edges:
        labels = edge_labels(rules.edges[feature])
        for e, label in zip(rules.edges[feature], labels):
            out = out.when(value <= e, label)
        return out.otherwise(labels[-1])
    cap, has_tail = rules.caps[feature]
    if has_tail:
        out = out.when(value >= cap, f"{show(cap)}+")
    return out.otherwise(F.when(value == F.floor(value), value.cast("long").cast("string"))
                         .otherwise(value.cast("string")))


def binned_cells(cell_df: DataFrame, rules: BinRules, split: str = "train") -> DataFrame:
    """Cells with their bin; category levels unseen in train share one bin."""
    bin_col = None
    for f in [*rules.edges, *rules.caps]:
        here = F.col("feature") == f
        bin_col = (F.when(here, number_bin(f, F.col("value"), rules)) if bin_col is None
                   else bin_col.when(here, number_bin(f, F.col("value"), rules)))
    numbers = cell_df.where(~F.col("feature").isin(*rules.categories)) if rules.categories else cell_df
    numbers = numbers.withColumn("bin", bin_col) if bin_col is not None else numbers.withColumn("bin", F.lit(MISSING))
    if not rules.categories:
        return numbers
    labels = cell_df.where(F.col("feature").isin(*rules.categories))
    seen = labels.where((F.col("split") == split) & F.col("text").isNotNull()) \
        .select("feature", "text", F.lit(True).alias("__seen")).distinct()
    labels = labels.join(seen, ["feature", "text"], "left").withColumn(
        "bin", F.when(F.col("text").isNull(), MISSING).when(F.col("__seen"), F.col("text")).otherwise(UNSEEN)).drop("__seen")
    return numbers.unionByName(labels.select(numbers.columns))


def bin_table(binned: DataFrame, rules: BinRules, train: str = "train", val: str = "validation") -> DataFrame:
    """Per (feature, bin) train and validation counts, rates, WoE, IV part and natural order."""
    on = lambda s, c: F.coalesce(F.sum(F.when(F.col("split") == s, F.col(c))), F.lit(0))
    table = binned.groupBy("feature", "bin").agg(
        on(train, "n").alias("n_train"), on(train, "fails").alias("fails_train"),
        on(val, "n").alias("n_val"), on(val, "fails").alias("fails_val"),
        F.min(F.when(F.col("split") == train, F.col("value"))).alias("lowest"))
    in_train = F.col("n_train") > 0
    w = Window.partitionBy("feature")
    k = F.sum(in_train.cast("int")).over(w)
    passes = F.col("n_train") - F.col("fails_train")
    table = table.withColumn("__pass", (passes + SMOOTH) / (F.sum(passes).over(w) + F.lit(SMOOTH) * k)) \
        .withColumn("__fail", (F.col("fails_train") + SMOOTH) / (F.sum("fails_train").over(w) + F.lit(SMOOTH) * k)) \
        .withColumn("fail_rate_train", F.try_divide(F.col("fails_train"), F.col("n_train"))) \
        .withColumn("fail_rate_val", F.try_divide(F.col("fails_val"), F.col("n_val"))) \
        .withColumn("woe", F.when(in_train, F.ln(F.col("__pass") / F.col("__fail")))) \
        .withColumn("iv_part", F.when(in_train, (F.col("__pass") - F.col("__fail")) * F.ln(F.col("__pass") / F.col("__fail"))))
    order = F.when(F.col("feature").isin(*rules.categories), F.col("fail_rate_train")).otherwise(F.col("lowest")) \
        if rules.categories else F.col("lowest")
    place = Window.partitionBy("feature").orderBy(F.col("bin").isin(MISSING, UNSEEN), order.asc_nulls_last(), "bin")
    return table.withColumn("position", F.row_number().over(place).cast("long")).drop("__pass", "__fail", "lowest")


def information_value(bins: DataFrame) -> DataFrame:
    return bins.groupBy("feature").agg(F.sum("iv_part").alias("iv"), F.count_if(F.col("n_train") > 0).alias("bins"))


def stability(bins: DataFrame) -> DataFrame:
    return metrics.psi_from_counts(bins, ["feature"], "bin", "n_train", "n_val")


def bin_auc(bins: DataFrame) -> DataFrame:
    """AUC when each row is scored by its bin's train rate; bins unseen in train get the train mean."""
    w = Window.partitionBy("feature")
    base = F.sum("fails_train").over(w) / F.sum("n_train").over(w)
    scored = bins.withColumn("score", F.coalesce(F.col("fail_rate_train"), base)).select(
        "feature", "score", F.expr("stack(2, 'auc_train', fails_train, n_train - fails_train, "
                                   "'auc_val', fails_val, n_val - fails_val) AS (part, pos, neg)"))
    cell_df = scan.cells(scored, ["feature", "part"], "score", {"pos": F.col("pos"), "neg": F.col("neg")})
    ranked = metrics.auc_from_cells(cell_df, "score", ["feature", "part"])
    return ranked.groupBy("feature").agg(
        F.max(F.when(F.col("part") == "auc_train", F.col("auc"))).alias("auc_train"),
        F.max(F.when(F.col("part") == "auc_val", F.col("auc"))).alias("auc_val"))


def monotonicity(bins: DataFrame, rules: BinRules) -> DataFrame:
    """Spearman correlation of bin order and rate over bins of 100 rows and more."""
    real = bins.where(~F.col("bin").isin(MISSING, UNSEEN) & (F.col("n_train") >= MONO_MIN_N))
    by_rate = Window.partitionBy("feature").orderBy("fail_rate_train")
    same = Window.partitionBy("feature", "fail_rate_train")
    ranked = real.select("feature", "position", (F.rank().over(by_rate) + (F.count("*").over(same) - 1) / 2).alias("r"),
                         F.row_number().over(Window.partitionBy("feature").orderBy("position")).alias("o"))
    rho = ranked.groupBy("feature").agg(F.count("*").alias("kept"), F.corr("r", "o").alias("rho"))
    word = (F.when(F.col("rho") >= 0.8, "rising").when(F.col("rho") <= -0.8, "falling").otherwise("mixed"))
    text = F.when(F.coalesce(F.col("kept"), F.lit(0)) < 3, "too few bins") \
        .otherwise(F.concat(word, F.lit(" ("), F.coalesce(F.format_string("%.2f", F.col("rho")), F.lit("nan")), F.lit(")")))
    if rules.categories:
        text = F.when(F.col("feature").isin(*rules.categories), "n/a (category)").otherwise(text)
    return bins.select("feature").distinct().join(rho, "feature", "left").select("feature", "rho", text.alias("monotonic"))


def flags(iv: Column, psi: Column, monotonic: Column) -> Column:
    """Gate flags as one text."""
    return F.concat_ws(
        "; ",
        F.when(iv < 0.02, "IV<0.02: drop unless domain reason"),
        F.when(iv > 0.5, "IV>0.5: check for leakage"),
        F.when(psi > 0.25, "PSI>0.25: unstable").when(psi > 0.1, "PSI 0.1-0.25: monitor"),
        F.when(monotonic.startswith("mixed"), "non-monotonic: explain or rebin"))


def severity(flag_text: Column) -> Column:
    """Red fails a gate, amber needs a look, green passes."""
    hit = lambda *words: F.coalesce(flag_text, F.lit("")).rlike("|".join(words))
    return (F.when(hit("IV<0\\.02", "IV>0\\.5", "PSI>0\\.25"), "red")
             .when(hit("monitor", "non-monotonic"), "amber").otherwise("green"))


def rate_by_year(binned: DataFrame, split: str = "train") -> DataFrame:
    """A26."""
    return (binned.where(F.col("split") == split).groupBy("feature", "bin", "year")
            .agg(F.sum("n").alias("n"), F.sum("fails").alias("fails"))
            .select("feature", "bin", "year", "n", (F.col("fails") / F.col("n")).alias("fail_rate")))


def summary(cell_df: DataFrame, bins: DataFrame, rules: BinRules, split: str = "train") -> DataFrame:
    """The univariate summary: one row per feature, all tables joined on a handful of keys."""
    shape = profile(cell_df.where(F.col("split") == split)).select(
        "feature", "missing_pct", "min", "max", "distinct_values")
    out = shape
    for part in (information_value(bins), bin_auc(bins), stability(bins), monotonicity(bins, rules)):
        out = out.join(F.broadcast(part), "feature")   # one row per feature
    flag = flags(F.col("iv"), F.col("psi"), F.col("monotonic"))
    return out.drop("rho").withColumn("flags", flag).withColumn("severity", severity(F.col("flags")))
