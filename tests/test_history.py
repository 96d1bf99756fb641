import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from erisk import INSPECTION_TEXT, ScopeRules, Settings
from erisk.operators import history as H
from erisk.plans import chart
from tests.helpers import by, entities, event, events, items, plain_cycles

S = Settings(sample_pct=100)


@pytest.fixture(scope="module")
def worked(spark):
    """The worked five-event history: T1..T5."""
    people = entities(spark, [("AB12CDE", "BMW", "320D", "2012-03-01", None)])
    tests = events(spark, [
        event("T1", "AB12CDE", "2016-03-01", "PASSED", 30000.0), event("T2", "AB12CDE", "2017-03-01", "PASSED", 40000.0),
        event("T3", "AB12CDE", "2019-03-01", "FAILED", 60000.0), event("T4", "AB12CDE", "2019-03-05", "PASSED", 60010.0),
        event("T5", "AB12CDE", "2020-03-01", "PASSED", 70000.0)])
    found = items(spark, [("T2", "ADVISORY", "tyre worn close to legal limit"), ("T2", "ADVISORY", "brake pipe corroded"),
                          ("T3", "MAJOR", "brake pad")])
    return people, tests, found


def test_worked_history(worked):
    rows = by(H.cycle_features_text(*worked, S, INSPECTION_TEXT), "mot_test_number")
    assert set(rows) == {"T3", "T5"}
    t3, t5 = rows["T3"], rows["T5"]
    assert (t3["target_failed"], t3["prev_failed"], t3["prev_advisories"], t3["prev_adv_tyres"], t3["prev_adv_brakes"],
            t3["prev_adv_corrosion"], t3["prev_adv_tyre_limit"], t3["n_prior_fails"], t3["age_years"]) == \
        (1, 0, 2, 1, 1, 1, 1, 0, 7.0)
    assert (t5["target_failed"], t5["prev_failed"], t5["n_prior_fails"], t5["days_since_prev"]) == (0, 1, 1, 366)
    assert t5["n_prior_fails_since"] == 1 and t5["n_prior_fails_before"] == 0
    assert t3["prev_test_before"] == 1 and t5["prev_test_before"] == 0
    assert t3["advisory_trend"] == 2 and t3["n_recurring_categories"] == 0
    assert t3["annual_miles_last_interval"] == round(10000 / 365 * 365.25)
    assert t3["projected_miles"] == round(40000 + t3["annual_miles_last_interval"] * 730 / 365.25)
    assert set(t3) >= {"reg_year", "fuel_type", "engine_size", "prev_minors"} and "__miles" not in t3


def test_all_entity_variant_agrees(worked):
    rows = by(H.cycle_features(*worked, S, ScopeRules()), "mot_test_number")
    assert set(rows) == {"T3", "T5"}
    assert rows["T5"]["prev_fail_items"] == 1 and rows["T5"]["prev_advisories"] == 0
    assert rows["T5"]["fails_last_3"] == 1 and rows["T5"]["n_prior_cycles"] == 3


def test_gap_rules(spark):
    rows = [event("a1", "A", "2020-01-01", "PASSED"), event("a2", "A", "2020-03-01", "PASSED"),     # 60 days: dropped
            event("b1", "B", "2020-01-01", "PASSED"), event("b2", "B", "2020-03-02", "PASSED"),     # 61 days: kept
            event("c1", "C", "2020-01-01", "PASSED"), event("c2", "C", "2020-02-20", "FAILED"),
            event("c3", "C", "2020-04-10", "PASSED"), event("c4", "C", "2020-05-30", "PASSED"),     # 50 + 50 + 50
            event("d1", "D", "2020-01-01 09:00:00", "PASSED"), event("d2", "D", "2020-01-01 09:00:00", "FAILED")]
    kept = H.cycles(H.first_of_day(H.prepare_events(events(spark, rows), S)), 60)
    assert sorted(r[0] for r in kept.select("mot_test_number").collect()) == ["a1", "b1", "b2", "c1", "d2"]
    flagged = by(H.flag_cycles(H.prepare_events(events(spark, rows), S), 60), "mot_test_number")
    assert flagged["d1"]["days_since_previous"] == 0 and flagged["d1"]["kept_as_cycle"] == 0
    assert flagged["c4"]["days_since_previous"] == 50 and flagged["a2"]["kept_as_cycle"] == 0


def test_population_filter(spark):
    rows = [event("ok", "A", "2020-01-01", "PASSED"), event("low", "B", "2020-01-01", "PASSED", source="dvsa"),
            event("other", "C", "2020-01-01", "PASSED", source="DVA"), event("none", "D", "2020-01-01", "PASSED", source=None),
            event("abandoned", "E", "2020-01-01", "ABANDONED"), event("late", "F", "2026-02-05", "PASSED"),
            event("edge", "G", "2026-02-04 23:59:59", "PASSED"), event("case", "H", "2020-01-01", "passed")]
    names = lambda s: {r["mot_test_number"] for r in H.prepare_events(events(spark, rows), s).collect()}
    assert names(S) == {"ok", "low", "edge"}
    assert names(S.with_(null_source_ok=True, fold_result_case=True)) == {"ok", "low", "edge", "none", "case"}
    as_text = events(spark, rows).withColumn("completed_date", F.date_format("completed_date", "yyyy-MM-dd'T'HH:mm:ss"))
    assert {r["mot_test_number"] for r in H.prepare_events(as_text, S).collect()} == {"ok", "low", "edge"}


def test_readings_and_start_dates(spark):
    people = entities(spark, [("A", "FORD", "KA", None, "2010-01-01"), ("B", "FORD", "KA", None, None),
                              ("C", "FORD", "KA", "2010-01-01", "2011-01-01")])
    rows = []
    for reg in "ABC":
        rows += [event(f"{reg}1", reg, "2016-01-01", "PASSED", 100000.0, unit="km"),
                 event(f"{reg}2", reg, "2017-01-01", "PASSED", 50000.0),
                 event(f"{reg}3", reg, "2018-01-01", "PASSED", 40000.0, kind="NO_ODOMETER"),
                 event(f"{reg}4", reg, "2019-01-01", "PASSED", 60000.0)]
    table = by(H.cycle_features(people, events(spark, rows), items(spark, [("A4", "ADVISORY", "x")]), S, ScopeRules(),
                                target_start="2015-01-01"), "mot_test_number")
    assert {k[0] for k in table} == {"A", "C"}
    assert table["A1"]["n_prior_fails"] is None and table["A1"]["prev_odometer"] is None and table["A1"]["days_since_prev"] is None
    assert table["A2"]["prev_odometer"] == pytest.approx(62137.1)
    assert table["A3"]["annual_miles_last_interval"] is None          # went backwards
    assert table["A4"]["prev_odometer"] is None and table["A4"]["n_prior_fails"] == 0
    assert table["A4"]["prev_advisories"] == 0                        # no items is 0, not NULL


def test_text_rule_needs_the_day(spark):
    people = entities(spark, [("A", "BMW", "320D", "2010-01-01", None)])
    rows = [event("a0", "A", "2016-01-01", "PASSED"), event("a1", "A", "2017-01-01", "PASSED"),
            event("a2", "A", "2019-01-01", "PASSED"), event("a3", "A", "2020-01-01", "PASSED")]
    coded = "Suspension arm worn (5.2.3 (e))"
    found = [(e, "ADVISORY", t) for e in ("a1", "a2") for t in (coded, "exhaust leak", "BRAKE pipe", "Child seat fitted")]
    table = by(H.cycle_features_text(people, events(spark, rows), items(spark, found), S, INSPECTION_TEXT), "mot_test_number")
    before, after = table["a2"], table["a3"]
    assert (before["prev_adv_suspension"], before["prev_adv_tyres"]) == (1, 0)   # keyword before the regime date
    assert (after["prev_adv_suspension"], after["prev_adv_tyres"]) == (0, 1)     # code since
    for row in (before, after):
        assert (row["prev_adv_other"], row["prev_adv_brakes"], row["prev_adv_leaks"], row["prev_advisories"]) == (1, 1, 0, 4)


def test_first_per_age_year_and_chart(spark):
    people = entities(spark, [("A", "BMW", "3 SERIES", "2015-01-01", None), ("B", "BMW", "M3", "2015-01-01", None)])
    rows = [event("a1", "A", "2018-12-20 08:00:00", "PASSED"), event("a2", "A", "2018-12-20 08:00:00", "FAILED"),
            event("a3", "A", "2019-01-20", "PASSED"), event("a4", "A", "2019-12-01", "PASSED"), event("b1", "B", "2019-01-01", "FAILED")]
    from erisk.functions.rules import family
    points = chart.chart_points(people, events(spark, rows), S.with_(min_cell=1),
                                family("BMW", "3 SERIES", "^3[0-9][0-9]")).collect()
    assert {(p["generation"], p["age"], p["tests"], p["fails"]) for p in points} == {("F30", 4, 1, 1), ("F30", 5, 1, 0)}
    checks = by(chart.chart_checks(spark.createDataFrame(points), S.with_(min_cell=1)), "check")
    assert checks["known generation"]["passed"] and not checks["enough events"]["passed"]


def random_events(seed, n, hot_share=0.0, keys=20):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "HOT" if rng.random() < hot_share else f"K{rng.randrange(keys)}"
        at = dt.datetime(2015, 1, 1) + dt.timedelta(days=rng.randrange(2500), hours=rng.randrange(3))
        rows.append((f"E{i:06d}", key, at, rng.choice(["PASSED", "FAILED"]), float(i), "mi", "READ", None, "DVSA"))
    return rows


def test_hot_entity_matches_brute_force(spark):
    """A third of all rows on one entity: same cycles as the plain loop, and the hot key is cut before its shuffle."""
    rows = random_events(1, 6000, hot_share=0.34)
    daily = H.first_of_day(H.prepare_events(events(spark, rows), S))
    got = sorted(r[0] for r in H.cycles(daily, 60).select("mot_test_number").collect())
    want = sorted(plain_cycles([(r[1], r[2].date(), r[2], int(r[3] == "FAILED"), r[0]) for r in rows], 60))
    assert got == want
    assert daily.where("registration = 'HOT'").count() <= 2500
    plan = H.cycles(daily, 60)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000))
def test_properties(spark, seed):
    rows = random_events(seed, 120, keys=4)
    people = entities(spark, [(k, "FORD", "KA", "2010-01-01", None) for k in ["HOT", *[f"K{i}" for i in range(4)]]])
    none = items(spark, [("E000000", "ADVISORY", "x")])
    cut = dt.datetime(2019, 6, 1)

    def table(chosen, parts=4):
        random.Random(seed).shuffle(chosen)
        out = H.cycle_features(people, events(spark, chosen).repartition(parts), none, S, ScopeRules(), "2015-01-01")
        return by(out, "mot_test_number")
    full = table(list(rows))
    assert table(list(rows), 1) == full                       # input order and partitions do not matter
    early = table([r for r in rows if r[2] < cut])
    assert all(full[k] == v for k, v in early.items())        # later events never change a feature
    days = {}
    for r in full.values():
        days.setdefault(r["registration"], []).append(r["test_date"])
    for ds in days.values():
        ds.sort()
        assert all((b - a).days > 60 for a, b in zip(ds, ds[1:]))


def test_safety_net_and_agreement(spark):
    rules = ScopeRules()
    people = entities(spark, [(f"S{i}", "SMART", "FORTWO", "2010-01-01", None, "PETROL", 700.0) for i in range(25)] +
                      [(f"X{i}", "XBRAND", "Z", "2010-01-01", None, "PETROL", 125.0 if i < 10 else 2000.0) for i in range(20)] +
                      [(f"Y{i}", "YAMAHA", "Z", "2010-01-01", None, "PETROL", 125.0) for i in range(30)])
    seen = events(spark, [event(f"e{r['registration']}", r["registration"], "2020-01-01", "PASSED") for r in people.collect()])
    out = by(H.safety_net(people, seen, S, rules, ("SMART",)), "make")
    assert set(out) == {"SMART", "XBRAND"}
    assert out["SMART"]["note"] == "known small cars" and out["XBRAND"]["note"] == "CHECK" and out["XBRAND"]["under_limit"] == 10
    found = items(spark, [("eS0", "ADVISORY", "tyre (5.2.3 (e))"), ("eS0", "ADVISORY", "tread (5.2.3 (e))"),
                          ("eS0", "ADVISORY", "tyre, child seat (5.2.1 (a))"), ("eS0", "MAJOR", "tyre (5.2.3 (e))")])
    pairs = by(H.rule_agreement(seen, found, S, INSPECTION_TEXT), "code_cat", "keyword_cat")
    assert {k: v["n"] for k, v in pairs.items()} == {("tyres", "tyres"): 1, ("tyres", "other"): 1}
    totals = by(H.agreement_by_code(H.rule_agreement(seen, found, S, INSPECTION_TEXT)), "code_cat")
    assert totals["ALL"]["agree_pct"] == 50.0


def test_repeats_and_one_history(spark):
    rows = [event("a1", "A", "2020-01-01 09:00:00", "PASSED"), event("a2", "A", "2020-01-01 12:00:00", "PASSED"),
            event("b1", "B", "2020-01-01", "PASSED"), event("b2", "B", "2021-01-01", "PASSED"),
            event("c1", "C", "2020-01-01", "ABANDONED"), event("c2", "C", "2020-02-01", "PASSED")]
    assert {r[0] for r in H.has_repeat(events(spark, rows), 60).collect()} == {"A", "C"}
    keys = spark.createDataFrame([("A",), ("A",)], "registration string")
    assert H.history_of(events(spark, rows), keys).count() == 2
