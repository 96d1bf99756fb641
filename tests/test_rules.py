import hashlib

from pyspark.sql import functions as F

from erisk import INSPECTION_TEXT, ScopeRules, Settings
from erisk.functions import bands as B, rules as R, text as T
from erisk.functions.stats import wilson
from erisk.sources.tables import register_functions

RULES = ScopeRules()


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_scope_and_labels(spark):
    rows = [("HONDA", "CIVIC TYPE R"), ("HONDA", "CBR 600"), ("BMW", "R1200 GS"), ("BMW", "320D"), (" vw ", "GOLF"), (None, None),
            ("BMW", None), ("Landrover", "x"), ("yamaha", "x"), ("HONDA", None), ("SUZUKI", "swift"), ("BMW", "unknown"), ("\tford\n", "ka")]
    got = values(spark, rows, "make string, model string", R.clean_label("make", RULES), R.in_scope("make", "model", RULES))
    assert got == [("HONDA", 1), ("HONDA", 0), ("BMW", 0), ("BMW", 1), ("VOLKSWAGEN", 1), ("UNKNOWN", 1), ("BMW", 0),
                   ("LAND ROVER", 1), ("YAMAHA", 0), ("HONDA", 0), ("SUZUKI", 1), ("BMW", 0), ("FORD", 1)]


def test_sql_functions_agree(spark):
    register_functions(spark, RULES, 20)
    rows = [("HONDA", "CIVIC"), ("BMW", "K1600"), (None, None), ("vw", "x"), ("Harley Davidson", "x")]
    spark.createDataFrame(rows, "make string, model string").createOrReplaceTempView("v")
    sql = spark.sql("SELECT clean_make(make), in_scope(make, model), in_sample(make) FROM v").collect()
    cols = values(spark, rows, "make string, model string", R.clean_label("make", RULES), R.in_scope("make", "model", RULES),
                  R.in_sample("make", 20))
    assert [tuple(r) for r in sql] == cols


def test_hash_sample(spark):
    keys = ["AB12CDE", "X1", "", None, "straße", *[f"K{i}" for i in range(50)]]
    want = [int(hashlib.md5((k or "").encode()).hexdigest(), 16) % 100 for k in keys]
    assert [r[0] for r in values(spark, [(k,) for k in keys], "k string", R.hash_bucket("k"))] == want


def test_numbers(spark):
    S = Settings()
    got = values(spark, [(2.9,), (3.0,), (24.99,), (25.0,), (None,)], "a double", B.age_key("a"))
    assert [r[0] for r in got] == ["3", "3", "24", "25+", None]
    assert [r[0] for r in values(spark, [(2.5,), (3.5,), (4.4,)], "a double", R.age_int(F.col("a")))] == [2, 4, 4]
    years = [(1985,), (1990,), (1991,), (1998,), (2012,), (2019,), (2020,)]
    assert [r[0] for r in values(spark, years, "y int", R.generation(F.col("y"), S))] == \
        ["E30 and older", "E30 and older", "E36", "E36", "E90", "F30", "G20"]
    rate = values(spark, [(100.0, 0), (-1.0, 10), (None, 10), (20.0, 10)], "m double, d int", R.annual_rate(F.col("m"), F.col("d")))
    assert [r[0] for r in rate] == [None, None, None, 730.0]
    dates = values(spark, [("2020-02-29",), ("2021-02-28",), ("2019-05-01",)], "t string", R.add_three_years(R.day("t")).cast("string"))
    assert [r[0] for r in dates] == ["2023-03-01", "2024-02-28", "2022-05-01"]
    assert [r[0] for r in values(spark, [("bad",), ("",), (None,)], "t string", R.day("t"))] == [None, None, None]
    lo, hi = wilson(F.lit(30), F.lit(100))
    assert values(spark, [(1,)], "x int", lo, hi) == [(21.9, 39.6)]


def test_bands(spark):
    rows = [(-1.0,), (0.0,), (5.0,), (5.1,), (100.0,), (101.0,), (None,)]
    assert [r[0] for r in values(spark, rows, "v double", B.right_closed("v", [0, 5, 100], ["a", "b"]))] == \
        [None, None, "a", "b", "b", None, None]
    assert [r[0] for r in values(spark, rows, "v double", B.left_closed("v", [0, 5, B.INF], ["a", "b"]))] == \
        [None, "a", "b", "b", "b", "b", None]
    assert [r[0] for r in values(spark, rows, "v double", B.first_edge("v", [0, 5], ["x", "y", "z"]))] == \
        ["x", "x", "y", "z", "z", "z", "no history"]
    assert [r[0] for r in values(spark, rows, "v double", B.presence("v"))] == ["no", "no", "yes", "yes", "yes", "yes", "no history"]
    assert B.interval_labels([0, 5, 8]) == ["(0, 5]", "(5, 8]"]


def test_keys_and_clamp(spark):
    rows = [(" ab 12cde ",), ("A",), ("AB-1",), ("ABCDEFGHI",)]
    assert values(spark, rows, "k string", R.clean_key("k"), R.valid_key("k")) == \
        [("AB12CDE", True), ("A", False), ("AB-1", False), ("ABCDEFGHI", False)]
    assert [r[0] for r in values(spark, [(0.0,), (0.5,), (2.0,), (None,)], "v double", R.clamp(F.col("v"), 0.01, 0.99))] == \
        [0.01, 0.5, 0.99, None]
    hot = values(spark, [("A",), ("C",), (None,)], "v string", *R.one_hot("v", ["A", "B"], "x_"))
    assert hot == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_item_category(spark):
    rows = [("tyre (1.1.2)", "2018-05-19", "ADVISORY"), ("tyre (1.1.2)", "2018-05-20", "ADVISORY"),
            ("Undertray fitted, tyre", "2020-01-01", "ADVISORY"), ("exhaust leak", "2020-01-01", "ADVISORY"),
            ("TRACK ROD end", "2020-01-01", "ADVISORY"), ("oil leak", "2020-01-01", "ADVISORY"), ("x", "2020-01-01", "MAJOR"),
            (None, "2020-01-01", "ADVISORY"), ("spring (5.3.1)", "2020-01-01", "ADVISORY"), ("hose (8.4.1)", "2020-01-01", "ADVISORY")]
    got = values(spark, rows, "t string, d string, k string", T.item_category(
        F.col("t"), R.day("d"), F.col("k"), "ADVISORY", "2018-05-20", INSPECTION_TEXT))
    assert [r[0] for r in got] == ["tyres", "brakes", "note", "other", "steering", "leaks", None, "other", "suspension", "leaks"]
