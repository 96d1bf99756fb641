import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from erisk import Settings
from erisk.operators import binning as B
from erisk.operators.quality import CheckFailed
from erisk.plans import univariate
from tests.helpers import by

S = Settings(validation_start="2020-01-01", test_start="2021-01-01")


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(4)
    n = 3000
    f = pd.DataFrame({"age": rng.gamma(3, 3, n), "fails": rng.poisson(1.2, n).astype(float), "fuel": rng.choice(["P", "D", "E"], n, p=[.6, .38, .02])})
    f["y"] = (rng.random(n) < 1 / (1 + np.exp(-(f.age / 9 + f.fails / 2 - 2)))).astype(int)
    f.loc[rng.random(n) < 0.1, ["age", "fails"]] = np.nan
    f["date"] = pd.to_datetime("2018-06-01") + pd.to_timedelta(rng.integers(0, 1100, n), unit="D")
    f.loc[(f.date < "2020-01-01") & (f.fuel == "E"), "fuel"] = "P"      # E is new in validation
    return f


@pytest.fixture(scope="module")
def result(spark, frame):
    df = spark.createDataFrame([(None if a != a else float(a), None if b != b else float(b), c, int(y), d.date())
                                for a, b, c, y, d in frame.itertuples(index=False)],
                               "age double, fails double, fuel string, y int, date date")
    return univariate.analyse(df, ["age", "fails"], ["fuel"], S, "y", "date")


def train_val(frame):
    return frame[frame.date < "2020-01-01"], frame[(frame.date >= "2020-01-01") & (frame.date < "2021-01-01")]


def test_edges_and_caps(result, frame):
    train, _ = train_val(frame)
    edges = np.unique(np.nanquantile(train.age.dropna(), np.linspace(0, 1, 11)))[1:-1]
    assert result.rules.edges["age"] == pytest.approx(list(edges))
    counts = train.fails.value_counts().sort_index()
    tail = counts[::-1].cumsum()[::-1]
    cap = tail[tail >= 0.02 * train.fails.notna().sum()].index.max()
    assert result.rules.caps["fails"] == (cap, train.fails.max() > cap)


def plain_bins(frame, result):
    edges = [-np.inf, *result.rules.edges["age"], np.inf]
    age = pd.cut(frame.age, edges, labels=B.edge_labels(result.rules.edges["age"])).astype(str)
    cap, has_tail = result.rules.caps["fails"]
    fails = frame.fails.map(lambda v: "missing" if v != v else (f"{int(cap)}+" if has_tail and v >= cap else str(int(v))))
    train, _ = train_val(frame)
    fuel = frame.fuel.where(frame.fuel.isin(train.fuel.unique()), B.UNSEEN)
    return {"age": age.where(frame.age.notna(), "missing"), "fails": fails, "fuel": fuel}


def test_tables(result, frame):
    bins = by(result.bins, "feature", "bin")
    train, val = train_val(frame)
    ivs, psis = by(B.information_value(result.bins), "feature"), by(B.stability(result.bins), "feature")
    assert ("fuel", B.UNSEEN) in bins and bins["fuel", B.UNSEEN]["n_train"] == 0
    for feature, labels in plain_bins(frame, result).items():
        t = train.groupby(labels[train.index]).y.agg(["count", "sum"])
        passes = t["count"] - t["sum"]
        ps = (passes + 0.5) / (passes.sum() + 0.5 * len(t))
        fs = (t["sum"] + 0.5) / (t["sum"].sum() + 0.5 * len(t))
        for b in t.index:
            assert bins[feature, b]["n_train"] == t.loc[b, "count"]
            assert bins[feature, b]["woe"] == pytest.approx(np.log(ps[b] / fs[b]))
        iv = ivs[feature]
        assert iv["iv"] == pytest.approx(((ps - fs) * np.log(ps / fs)).sum()) and iv["bins"] == len(t)
        names = sorted(set(labels[train.index]) | set(labels[val.index]))
        p = labels[train.index].value_counts(normalize=True).reindex(names, fill_value=0) + 1e-6
        q = labels[val.index].value_counts(normalize=True).reindex(names, fill_value=0) + 1e-6
        assert psis[feature]["psi"] == pytest.approx(((q - p) * np.log(q / p)).sum())


def test_order_monotonicity_and_summary(result):
    ages = [r["bin"] for r in result.bins.where("feature = 'age'").orderBy("position").collect()]
    assert ages == [*B.edge_labels(result.rules.edges["age"]), "missing"]
    mono = by(B.monotonicity(result.bins, result.rules), "feature")
    assert mono["age"]["monotonic"].startswith("rising") and mono["fuel"]["monotonic"] == "n/a (category)"
    summary = by(result.summary(), "feature")
    assert summary["age"]["distinct_values"] > 1000 and summary["age"]["severity"] == "green"
    assert summary["fuel"]["severity"] == "red" and "PSI>0.25" not in summary["age"]["flags"]
    assert 0.5 < summary["age"]["auc_val"] < 1 and summary["fails"]["missing_pct"] == pytest.approx(10, abs=3)
    years = result.by_year().collect()
    assert {r["year"] for r in years} == {2018, 2019}


def test_flag_texts(spark):
    rows = [(0.01, 0.3, "mixed (0.10)"), (0.6, 0.2, "rising (0.90)"), (0.1, 0.05, "rising (1.00)")]
    df = spark.createDataFrame(rows, "iv double, psi double, m string").withColumn(
        "f", B.flags(F.col("iv"), F.col("psi"), F.col("m"))).withColumn("s", B.severity(F.col("f")))
    assert [tuple(r) for r in df.select("f", "s").collect()] == [
        ("IV<0.02: drop unless domain reason; PSI>0.25: unstable; non-monotonic: explain or rebin", "red"),
        ("IV>0.5: check for leakage; PSI 0.1-0.25: monitor", "red"), ("", "green")]


def test_missing_column(spark):
    with pytest.raises(CheckFailed):
        univariate.analyse(spark.createDataFrame([(1,)], "y int"), ["age"], [], S, "y", "date")
