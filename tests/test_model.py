import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from erisk import ScopeRules, Settings
from erisk.functions.stats import sigmoid
from erisk.operators import model as M
from erisk.plans import pilot, training
from erisk.sources import models as SM
from erisk.sources.tables import write_lines
from tests.helpers import by

S = Settings(validation_start="2020-01-01", test_start="2021-01-01", min_cell=10)


def newton(X, y, c, steps=50):
    """Minimise 0.5 |w|^2 + c * sum(log loss), intercept not penalised."""
    A = np.column_stack([X, np.ones(len(X))])
    w = np.zeros(A.shape[1])
    pen = np.diag([1.0] * X.shape[1] + [0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-A @ w))
        w -= np.linalg.solve(pen + c * (A * (p * (1 - p))[:, None]).T @ A, pen @ w + c * A.T @ (p - y))
    return w


@pytest.fixture(scope="module")
def features(spark):
    """Generated rows with a real signal: known coefficients on age, prior fails and one make."""
    rng = np.random.default_rng(7)
    n = 6000
    day = rng.integers(0, 1500, n)
    age = np.round(rng.uniform(3, 20, n), 2)
    hist = rng.random(n) > 0.1
    prior = rng.poisson(1.5, n)
    last3 = np.minimum(prior, rng.integers(0, 4, n))
    odo = rng.normal(60000, 20000, n)
    make = rng.choice(["FORD", "KIA", "VW", "RARE"], n, p=[.4, .3, .25, .05])
    z = -2 + 0.12 * age + np.where(hist, 0.35 * prior, 0) + 0.6 * (make == "FORD") - 0.2
    y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    rows = []
    for i in range(n):
        h = bool(hist[i])
        rows.append((f"r{i}", f"t{i}", int(y[i]), str(make[i]), ["P", "D"][i % 2], float(age[i]), int(prior[i]) if h else 0,
                     int(prior[i]) if h else None, int(last3[i]) if h else None,
                     float(odo[i]) if h and rng.random() > 0.05 else None, int(rng.integers(0, 3)) if h else None,
                     int(rng.integers(0, 3)) if h else None, int(rng.integers(300, 500)) if h else None, int(day[i])))
    df = spark.createDataFrame(rows, "registration string, mot_test_number string, target_failed bigint, make string, fuel_type string, "
                               "age_years double, n_prior_cycles bigint, n_prior_fails bigint, fails_last_3 bigint, prev_odometer double, "
                               "prev_fail_items bigint, prev_advisories bigint, days_since_prev bigint, __d int")
    return df.withColumn("test_date", F.date_add(F.lit("2018-06-01").cast("date"), F.col("__d"))).drop("__d").repartition(4)


@pytest.fixture(scope="module")
def trained(features):
    return training.train(features, S, ScopeRules(), n_makes=3, min_group=50, version="1.0")


def test_fit_matches_newton(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(1500, 2))
    y = (rng.random(1500) < 1 / (1 + np.exp(-(X @ [1.0, -0.5] + 0.3)))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(X, y)], "a double, b double, y int")
    for c in (0.05, 1.0, 1e6):
        coefs, intercept = M.fit_logistic(df, ["a", "b"], "y", c)
        assert [*coefs, intercept] == pytest.approx(list(newton(X, y, c)), abs=1e-5)


def test_training(trained, features, spark):
    m = trained.model
    assert m["columns"][:7] == list(M.NUMERIC) and m["preprocessing"]["makes"] == ["FORD", "KIA", "VW"]
    coef = dict(zip(m["columns"], m["coefficients"]))
    sd = m["preprocessing"]["sds"]
    assert coef["age_years"] / sd["age_years"] == pytest.approx(0.12, abs=0.03)
    assert coef["make_FORD"] - coef["make_KIA"] == pytest.approx(0.6, abs=0.2)
    scores = by(trained.scores, "score")
    assert scores["p"]["auc"] > scores["p_base"]["auc"] > 0.5 and scores["p"]["brier_skill"] > 0
    assert set(m["bands"]["cutoffs_by_age"]) == {str(a) for a in range(3, 25)} | {"25+"}
    train = features.where("test_date < '2020-01-01'")
    pdf = train.toPandas()
    h = pdf[pdf.n_prior_fails.notna()]
    assert m["preprocessing"]["fill_values"]["prev_odometer"] == pytest.approx(h.prev_odometer.median())
    assert m["preprocessing"]["fill_values"]["age_years"] == pytest.approx(pdf.age_years.median())
    assert sd["fails_last_3"] == pytest.approx(pdf.fails_last_3.fillna(0).std())
    assert m["training"]["train_cycles"] == len(pdf)
    # design matrix by hand for one row
    row = features.where("mot_test_number = 't1'").withColumn("z", M.raw_logit(m)).first()
    parts = M.contributions(features.where("mot_test_number = 't1'"), m, "mot_test_number").agg(F.sum("contribution")).first()[0]
    assert row["z"] == pytest.approx(m["intercept"] + parts, abs=1e-6)


def test_cutoffs_and_bands(trained, features, spark):
    val = features.where("test_date >= '2020-01-01' and test_date < '2021-01-01'").withColumn("p", M.probability(trained.model))
    cuts = by(M.learn_cutoffs(val, "p", min_group=50), "age_key")
    pdf = val.select("p", F.floor("age_years").alias("a")).toPandas()
    for k in ("5", "12"):
        sub = pdf[pdf.a == int(k)].p
        want = np.quantile(sub if len(sub) >= 50 else pdf.p, [0.4, 0.8])
        assert [cuts[k]["low"], cuts[k]["high"]] == pytest.approx(list(want))
    assert [cuts["24"]["low"], cuts["24"]["high"]] == pytest.approx(list(np.quantile(pdf.p, [0.4, 0.8])))   # no rows: overall
    model = {"bands": {"cutoffs_by_age": {"3": [0.2, 0.4]}}}
    got = spark.createDataFrame([(0.1,), (0.2,), (0.4,)], "p double").select(M.band(model, F.col("p"), F.lit(3.5))).collect()
    assert [r[0] for r in got] == ["Lower risk", "Typical", "Higher risk"]      # on a cut-off: the higher band
    with pytest.raises(Exception, match="no band cut-offs"):
        spark.createDataFrame([(0.1,)], "p double").select(M.band(model, F.col("p"), F.lit(9.0))).collect()


def test_round_trip_and_refit(trained, features, spark, tmp_path):
    SM.save_model(spark, trained.model, str(tmp_path / "model"))
    back = SM.load_model(spark, str(tmp_path / "model"))
    assert back["coefficients"] == trained.model["coefficients"] and back["bands"] == trained.model["bands"]
    assert SM.rules_from_block(back["vehicle_rules"]).merges == ScopeRules().merges
    a = features.select("mot_test_number", M.probability(back).alias("p")).orderBy("mot_test_number").limit(50).collect()
    b = features.select("mot_test_number", M.probability(trained.model).alias("p")).orderBy("mot_test_number").limit(50).collect()
    assert a == b
    refit = M.fit_model(features.where("test_date < '2020-01-01'").repartition(3), "target_failed", 3)
    assert M.refit_difference(trained.model, refit) < 1e-4
    table = by(M.coefficient_table(spark, trained.model), "feature")
    assert table["age_years"]["sign_check"] == "" and table["age_years"]["odds_ratio"] == pytest.approx(np.exp(table["age_years"]["coefficient"]))
    units = by(M.readable_units(spark, trained.model), "feature")
    assert units["age_years"]["odds_ratio_per_readable_unit"] == pytest.approx(np.exp(table["age_years"]["coefficient"] / units["age_years"]["sd"]))
    off = M.override(trained.model, zero_prefix="make_", calibration=(1.0, 0.0))
    assert off["coefficients"][-3:] == [0.0] * 3 and trained.model["coefficients"][-1] != 0.0


def test_validation_gates(trained, features, tmp_path):
    result = training.validate(features, trained.model, S, reps=60, segment_min=200)
    gates = by(result["gates"], "gate")
    assert len(gates) == 5 and gates["Bands rise from Lower to Typical to Higher risk"]["passed"]
    assert gates["Calibration slope 0.9 to 1.1"]["value"] == pytest.approx(1.0, abs=0.25)
    assert gates["Beats the baseline, intervals not overlapping"]["passed"]
    assert result["psi"].first()["label"] in ("stable", "monitor")
    assert {r["dimension"] for r in result["segments"].collect()} == {"make", "fuel", "age band", "history"}
    write_lines(training.report_lines(result), str(tmp_path / "report"))
    text = "\n".join(p.read_text() for p in (tmp_path / "report").glob("part-*"))
    assert "Calibration slope" in text and "PASS  " in text and "segments checked" in text and "Gini" in text
    said = [r["line"] for r in training.report_lines(result).orderBy("position").collect()]
    where = lambda start: next(k for k, x in enumerate(said) if x.startswith(start))
    assert said[0].startswith("Validation") and where("Lower risk") < where("Typical") < where("Higher risk")
    assert [x[6:] for x in said[-5:]] == list(training.GATES)


def test_platt(features, spark):
    df = features.withColumn("p", sigmoid(F.col("age_years") / 10 - 1))
    fn = M.platt_of_probability(df, "p", "target_failed")
    r = df.agg(F.avg(fn(F.col("p"))), F.avg("target_failed")).first()
    assert r[0] == pytest.approx(r[1], abs=1e-4)      # calibrated in the large on the rows it was fitted to


def test_pilot(features, spark):
    f = features.select("*", F.lit(2010).alias("reg_year"), (F.col("age_years") * 100).alias("engine_size"),
                        F.lit(0).alias("prev_failed"), F.when(F.col("n_prior_fails").isNotNull(), 1).alias("prev_minors"),
                        F.col("prev_advisories").alias("prev_adv_tyres"))
    out = pilot.compare(f, S, fuels=("P",), boosting_rounds=8, text_features=("prev_adv_tyres",))
    scores = by(out["scores"], "model")
    assert set(scores) == {"Baseline (gen + age)", "Logistic", "Boosting", "Logistic + text", "Boosting + text"}
    assert all(r["auc"] > 0.55 for r in scores.values()) and scores["Logistic"]["auc"] > scores["Baseline (gen + age)"]["auc"]
    imp = by(pilot.importances(out, "Boosting", repeats=2), "feature")
    assert max(imp, key=lambda k: imp[k]["importance"]) in ("age_years", "engine_size", "n_prior_fails")
    bands = by(pilot.peer_bands(out["predictions"], "Logistic"), "band")
    assert bands["Lower risk"]["fail_rate"] < bands["Higher risk"]["fail_rate"]


def test_pilot_query_fits_all_rounds(spark, monkeypatch):
    """The query leaves the rounds to early stopping, which waits and does not end at the first worse round."""
    from workload import queries

    real, seen = inspect.signature(pilot.compare), []
    monkeypatch.setattr(queries.W, "text_features", lambda *_: None)
    monkeypatch.setattr(queries.pilot, "compare", lambda *a, **k: seen.append(real.bind(*a, **k)) or {"scores": spark.range(1)})
    queries.QUERIES["pilot_scores"](spark, "")
    seen[0].apply_defaults()
    assert seen[0].arguments["boosting_rounds"] == 500
