import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from erisk import Settings
from erisk.operators import quality as Q
from erisk.sources import tables as T
from erisk.sources.records import chart_document
from tests.helpers import by

ROW = ("A", "t1", None, 1, "E", None, 3.5, 0, None, None, None, None, None, None, None)


def test_csv_and_parquet_round_trip(spark, tmp_path):
    df = spark.createDataFrame([ROW, ROW[:4] + ("007",) + ROW[5:]], T.FEATURE_SCHEMA).withColumn(
        "test_date", F.lit("2020-05-01").cast("date"))
    T.write_features_csv(df, str(tmp_path / "csv"))
    back = T.read_features_csv(spark, str(tmp_path / "csv"))
    assert {r["make"] for r in back.collect()} == {"E", "007"} and back.schema.simpleString() == df.schema.simpleString()
    T.write_features(df, str(tmp_path / "pq"))
    part = T.read_table(spark, str(tmp_path / "pq")).where("test_year = 2020")
    assert part.count() == 2 and "PartitionFilters: [isnotnull(test_year" in part._jdf.queryExecution().executedPlan().toString()
    T.write_report(back.select("make", "age_years"), str(tmp_path / "report"), order=["make"])
    assert T.read_table(spark, str(tmp_path / "report"), "make string, age_years double", "csv").count() >= 2


def test_bucketed_tables_join_in_place(spark, tmp_path):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for name in ("bucketed_events", "bucketed_items"):
        T.write_bucketed(spark.range(100).select(F.col("id").cast("string").alias("mot_test_number"), F.lit("ADVISORY").alias("type")),
                         name, "mot_test_number", 4, str(tmp_path / name))
    from erisk import Settings as S
    from erisk.operators.history import item_counts, with_items
    joined = with_items(spark.table("bucketed_events").select("mot_test_number"), item_counts(spark.table("bucketed_items"), S()))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and joined.agg(F.sum("n_advisory")).first()[0] == 100
    for name in ("bucketed_events", "bucketed_items"):
        spark.sql(f"DROP TABLE {name}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_missing_source_fails(spark, tmp_path):
    with pytest.raises(AnalysisException):
        T.read_table(spark, str(tmp_path / "nothing"))


def test_named_parameters_and_one_entity(spark):
    spark.createDataFrame([("A", "2020-01-02"), ("A", "2020-01-01"), ("B", "2020-01-01")], "registration string, completed_date string") \
        .createOrReplaceTempView("ev")
    assert T.query(spark, "SELECT * FROM ev WHERE registration = :key AND completed_date >= :start", key="A", start="2020-01-02").count() == 1
    assert [r[1] for r in T.one_entity(spark.table("ev"), "A").collect()] == ["2020-01-01", "2020-01-02"]


def test_chart_document(spark):
    S = Settings()
    pts = spark.createDataFrame([("G20", 3, 50, 5, 10.0, 4.3, 21.4), ("E36", 20, 40, 20, 50.0, 35.2, 64.8), ("E36", 19, 60, 30, 50.0, 37.7, 62.3)],
                                "generation string, age int, tests bigint, fails bigint, fail_pct double, ci_low double, ci_high double")
    doc = json.loads(chart_document(pts, S.generation_order, {"title": F.lit("t"), "min_tests_per_point": F.lit(30)}).first()[0])
    assert [s["generation"] for s in doc["series"]] == ["E36", "G20"] and doc["meta"]["total_tests"] == 150
    assert [p["age"] for p in doc["series"][0]["points"]] == [19, 20]


def test_checks(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 5.0)], "k string, v double")
    checks = by(Q.check_table(df, {"positive": F.col("v") > 0, "small": F.col("v") < 100, "named": F.col("k").isNotNull()}), "check")
    assert checks["positive"]["violations"] == 1 and not checks["positive"]["passed"] and checks["named"]["passed"]
    assert [r[0] for r in Q.outside_domain(df, "k", ["a", "b"]).collect()] == ["c"]
    with pytest.raises(Q.CheckFailed):
        Q.require(Q.check_table(df, {"positive": F.col("v") > 0}))
    with pytest.raises(Q.CheckFailed):
        Q.require_rows(df.where("false"))
    with pytest.raises(Q.CheckFailed):
        Q.require_columns(df, ["k", "missing"])
    assert Q.require(Q.total_check(df, "enough", F.sum("v"), 5)).first()["passed"]
