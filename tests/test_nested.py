import json
import random

import pytest
from pyspark.sql import functions as F

from erisk import ScopeRules, Settings
from erisk.operators import history as H, model as M, nested as N
from erisk.sources import records as RC
from erisk.sources.models import with_provenance
from erisk.sources.tables import RECORD_SCHEMA
from erisk.streaming import jobs
from tests.helpers import by, entities, events, items
from tests.test_history import random_events
from workload.roles import MODEL

S = Settings(sample_pct=100)
RULES = ScopeRules()
READY = with_provenance(MODEL, RULES, {}, "m", "1.0", "", built="2020-01-01")


def record(reg, tests, make="FORD", model="KA", first="2012-03-01", registered=None):
    return {"registration": reg, "make": make, "model": model, "firstUsedDate": first, "registrationDate": registered,
            "motTests": tests}


def a_test(number, at, result, value="1000", unit="mi", kind="READ", expiry=None, source="DVSA", defects=()):
    return {"motTestNumber": number, "completedDate": at, "testResult": result, "odometerValue": value, "odometerUnit": unit,
            "odometerResultType": kind, "expiryDate": expiry, "dataSource": source,
            "defects": [{"type": t, "text": "x", "dangerous": False} for t in defects]}


def frame(spark, docs):
    return RC.parse_records(spark.createDataFrame([(json.dumps(d),) for d in docs], "value string"), "value")


def score(spark, docs, today="2020-06-01"):
    return by(N.score_records(frame(spark, docs), READY, S, F.lit(today).cast("date"), RULES), "registration")


def test_due_date_and_features(spark):
    docs = [
        record("OK", [a_test("1", "2018-01-01T10:00:00.000Z", "PASSED", expiry="2019-01-01"),
                      a_test("2", "2019-01-05T10:00:00.000Z", "FAILED", defects=("MAJOR", "advisory")),
                      a_test("3", "2019-01-20T10:00:00.000Z", "PASSED", expiry="2020-12-31", source=None),
                      a_test("4", "2019-12-01T10:00:00.000Z", "passed", value="bad", source="DVA")]),
        record("NEW", [], first="2019-02-28"), record("LEAP", [], first="2020-02-29"), record("OLD", [], first="2001-01-01"),
        record("NOSTART", [], first="", registered=None), record("BLANK", [], first="", registered="2010-01-01"),
        record("BIKE", [], make="YAMAHA")]
    out = score(spark, docs)
    ok = out["OK"]
    assert str(ok["due_date"]) == "2020-12-31"           # a retest pass sets the expiry
    assert (ok["n_prior_fails"], ok["fails_last_3"], ok["prev_fail_items"], ok["prev_advisories"]) == (1, 1, 1, 1)
    assert ok["days_since_prev"] == 726 and ok["first_mot"] is False and ok["band"] in M.BANDS and ok["model_version"] == "1.0"
    assert str(out["NEW"]["due_date"]) == "2022-02-28" and out["NEW"]["first_mot"] is True
    assert str(out["LEAP"]["due_date"]) == "2023-03-01" and str(out["OLD"]["due_date"]) == "2020-06-01"
    assert out["BLANK"]["supported"] and not out["NOSTART"]["supported"] and out["NOSTART"]["message"] == N.NO_START
    assert out["BIKE"]["message"] == N.NOT_COVERED and out["BIKE"]["probability"] is None
    assert out["OK"]["probability"] == round(out["OK"]["probability"], 3)


def test_short_histories_and_ties(spark):
    many = [a_test(str(i), f"{2010 + i}-01-01T10:00:00.000Z", "FAILED" if i != 2 else "PASSED") for i in range(5)]
    docs = [record("ONE", many[:1]), record("FIVE", many),
            record("TIE", [a_test("p", "2018-01-01T10:00:00.000Z", "PASSED", value="1"),
                           a_test("f", "2018-01-01T10:00:00.000Z", "FAILED", value="2")])]
    out = score(spark, docs)
    assert out["ONE"]["fails_last_3"] == 1 and out["FIVE"]["fails_last_3"] == 2 and out["FIVE"]["n_prior_fails"] == 4
    assert out["TIE"]["prev_odometer"] == 2.0 and out["TIE"]["n_prior_fails"] == 1


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(9)
    rows = random_events(11, 900, hot_share=0.34, keys=30)
    people = entities(spark, [(k, "FORD", "KA", "2010-01-01", None) for k in ["HOT", "EMPTY", *[f"K{i}" for i in range(30)]]])
    found = [(rng.choice(rows)[0], rng.choice(["ADVISORY", "MAJOR", "MINOR"]), rng.choice(["tyre", "brake"])) for _ in range(1500)]
    found += [(rows[0][0], "ADVISORY", "same")] * 700          # one event holds a third of all items, all copies
    return people, events(spark, rows), items(spark, found)


def test_round_trip(tables):
    people, tests, found = tables
    docs = RC.export_records(people, tests, found, max_tests=40, max_items=50)
    parts = {r["registration"]: r["n"] for r in docs.groupBy("registration").agg(F.count("*").alias("n")).collect()}
    assert parts["HOT"] > 1 and parts["EMPTY"] == 1
    assert docs.agg(F.max(F.size("motTests"))).first()[0] <= 120
    assert docs.select(F.explode("motTests.defects").alias("d")).agg(F.max(F.size("d"))).first()[0] <= 250
    back_people, back_tests, back_items = RC.to_tables(docs)
    assert back_people.count() == people.count() and back_tests.count() == tests.count()
    count = lambda df: {tuple(r) for r in df.groupBy("mot_test_number", "type", "text").count().collect()}
    assert count(back_items) == count(found)               # nothing dropped, no copy lost


def test_too_many_hot_keys_for_a_list(tables, monkeypatch):
    """Past the broadcast limit every key takes the way that needs no list; the content is the same."""
    people, tests, found = tables
    content = lambda docs: sorted(map(tuple, RC.to_tables(docs)[2].groupBy("mot_test_number", "type", "text").count().collect()))
    want = content(RC.export_records(people, tests, found, max_tests=40, max_items=50))
    monkeypatch.setattr(RC, "MAX_BROADCAST", 0)
    docs = RC.export_records(people, tests, found, max_tests=40, max_items=50)
    assert content(docs) == want
    assert docs.select("registration").distinct().count() == people.count()


def test_parity_with_parts(tables, spark):
    """Relational and nested features agree on every cycle, hot entities in parts included."""
    people, tests, found = tables
    f = H.cycle_features(people, tests, found, S, RULES, target_start="2015-01-01")
    scored = M.scored(f, MODEL)
    for limit in (40, 5000):
        docs = RC.export_records(people, tests, found, max_tests=limit, max_items=limit)
        got = N.features_at(docs, f.select("registration", "test_date"), S).withColumn("make", F.lit("FORD"))
        checks = N.parity(scored, M.scored(got, MODEL), ["registration", "test_date"], [*M.NUMERIC, "p", "band"])
        assert checks.count() == f.count() * 9 and checks.where(~F.col("ok")).isEmpty()
    broken = M.scored(got, MODEL).withColumn("prev_advisories", F.col("prev_advisories") + 1)
    bad = N.parity(scored, broken, ["registration", "test_date"], ["prev_advisories"])
    assert bad.where(~F.col("ok")).count() == f.where("prev_advisories IS NOT NULL").count()


def test_scores_do_not_depend_on_parts(tables, spark):
    people, tests, found = tables
    today = F.lit("2019-01-01").cast("date")
    one = by(N.score_records(RC.export_records(people, tests, found), READY, S, today, RULES), "registration")
    many = by(N.score_records(RC.export_records(people, tests, found, max_tests=25, max_items=30), READY, S, today, RULES), "registration")
    assert one == many and len(one) == 32


def test_events_after_the_snapshot_count(spark):
    """The end of the training snapshot is no cut for a record, whole or in parts."""
    tests = [a_test("1", "2023-12-01T10:00:00.000Z", "PASSED", value="50000"), a_test("2", "2026-06-01T10:00:00.000Z", "FAILED", value="61000")]
    docs = [record("A", tests), record("B", tests[:1]) | {"part": 0, "n_parts": 2}, record("B", tests[1:]) | {"part": 1, "n_parts": 2}]
    out = score(spark, docs, "2026-12-01")
    for key in "AB":
        assert (out[key]["n_prior_fails"], out[key]["prev_odometer"], out[key]["days_since_prev"]) == (1, 61000.0, 183)


def test_parts_survive_json_and_streams(tables, spark, tmp_path):
    """Parts of one entity in different files and micro-batches are scored once, when all have arrived."""
    people, tests, found = tables
    docs = RC.export_records(people, tests, found, max_tests=25, max_items=30, max_document_items=60).cache()
    assert docs.where("n_parts > 1").count() > 1
    today = F.lit("2019-01-01").cast("date")
    want = by(N.score_records(RC.export_records(people, tests, found), READY, S, today, RULES), "registration")
    docs.where("part % 2 = 0").coalesce(1).write.json(str(tmp_path / "in"))
    docs.where("part % 2 = 1").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    assert by(N.score_records(RC.read_records(spark, str(tmp_path / "in")), READY, S, today, RULES), "registration") == want
    stream = spark.readStream.schema(RECORD_SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    rows = jobs.score_to_table(spark, stream, READY, S, today, str(tmp_path / "job"))
    assert rows.count() == len(want) and by(rows, "registration") == want


def test_a_lost_part_is_reported_after_its_limit(tables, spark, tmp_path):
    """Parts over three runs of the job: one entity is completed after a restart, one never is."""
    people, tests, found = tables
    docs = RC.export_records(people, tests, found, max_tests=25, max_items=30, max_document_items=60).cache()
    today = F.lit("2019-01-01").cast("date")
    hot = [r["registration"] for r in docs.where("n_parts > 1").select("registration").distinct().orderBy("registration").collect()]
    want = by(N.score_records(RC.export_records(people, tests, found), READY, S, today, RULES), "registration")
    gone = docs.where("part = 0").where(F.col("registration") == hot[0]).withColumn("registration", F.lit("GONE"))

    def send(df, at):
        df.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(RECORD_SCHEMA).json(str(tmp_path / "in"))
        return jobs.score_to_table(spark, stream, READY, S, today, str(tmp_path / "job"), 3600, F.lit(at).cast("timestamp"))

    first = send(docs.where("part = 0 AND n_parts > 1").unionByName(gone), "2020-01-01 00:00:00")
    assert first.count() == 0 and jobs.lost_parts(spark, str(tmp_path / "job")).count() == 0
    second = send(docs.where("part > 0 AND n_parts > 1"), "2020-01-01 00:30:00")
    assert {r["registration"] for r in second.collect()} == set(hot)
    rows = send(docs.where("coalesce(n_parts, 1) = 1"), "2020-01-01 00:40:00")
    late = docs.where("n_parts > 1").where(F.col("registration") == hot[0]).withColumn("registration", F.lit("LATER")).where("part = 0")
    rows = send(late, "2020-01-01 03:00:00")
    assert by(rows, "registration") == want and rows.count() == len(want)
    lost = {r["registration"]: (r["n_seen"], r["n_parts"]) for r in jobs.lost_parts(spark, str(tmp_path / "job")).collect()}
    assert set(lost) == {"GONE"} and lost["GONE"][0] == 1 < lost["GONE"][1]


def test_no_task_holds_all_parts(tables):
    """The export joins entity attributes on (entity, part)."""
    people, tests, found = tables
    plan = RC.export_records(people, tests, found, max_tests=25)._jdf.queryExecution().optimizedPlan().toString()
    last = next(line for line in plan.splitlines() if "Join LeftOuter" in line)
    assert "registration" in last and "part" in last


def test_narrow_plan(spark):
    docs = frame(spark, [record("A", [])]).drop("part", "n_parts")
    plan = N.score_records(docs, READY, S, F.lit("2020-01-01").cast("date"), RULES) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Generate" not in plan


def test_stream_equals_batch(spark, tmp_path, tables):
    people, tests, found = tables
    RC.export_records(people, tests, found).write.json(str(tmp_path / "in"))
    today = F.lit("2019-01-01").cast("date")
    batch = N.score_records(RC.read_records(spark, str(tmp_path / "in")), READY, S, today, RULES)   # no entity is in parts here
    stream = jobs.score_stream(RC.read_records(spark, str(tmp_path / "in"), stream=True), READY, S, today)
    jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    out = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert by(out, "registration") == by(batch, "registration")


def test_cases_file(spark, tmp_path, tables):
    people, tests, found = tables
    f = M.scored(H.cycle_features(people, tests, found, S, RULES, target_start="2018-01-01"), MODEL).limit(10)
    docs = RC.export_records(people, tests, found)
    cases = f.join(docs.select(F.struct(*[f.name for f in RECORD_SCHEMA.fields]).alias("vehicle"), "registration"), "registration").select(
        F.lit("random").alias("group"), F.col("test_date").alias("target_date"), "vehicle", F.struct(
            F.create_map(*[x for c in M.NUMERIC for x in (F.lit(c), F.col(c).cast("double"))]).alias("features"),
            "make", F.col("p").alias("probability"), "band").alias("expected"))
    RC.write_cases(cases, str(tmp_path / "cases"))
    back = RC.read_cases(spark, str(tmp_path / "cases"))
    assert back.count() == 10
    got = N.features_at(back.select("vehicle.*"), back.select("vehicle.registration", F.col("target_date").alias("test_date")).distinct(), S)
    want = back.select("vehicle.registration", F.col("target_date").alias("test_date"),
                       *[F.col("expected.features")[c].alias(c) for c in M.NUMERIC])
    assert N.parity(want, got.distinct(), ["registration", "test_date"], M.NUMERIC).where(~F.col("ok")).isEmpty()


def test_low_limits_do_not_deal_ordinary_keys(tables):
    """Parts of what fits one task come from the shuffle by entity; only hot keys are dealt by (entity, part)."""
    people, tests, found = tables
    docs = RC.export_records(people, tests, found, max_tests=6, max_items=4, max_document_items=30)
    assert docs.where("n_parts > 1").count() > 0
    assert "RepartitionByExpression [registration" not in docs._jdf.queryExecution().optimizedPlan().toString()


def test_hot_keys_give_the_same_parts(tables, monkeypatch):
    people, tests, found = tables
    export = lambda: sorted((r["registration"], r["part"], r["n_parts"], str(r["motTests"])) for r in RC.export_records(people, tests, found, max_tests=40, max_items=50).collect())
    want = export()
    for name, limit in (("HOT_TESTS", 41), ("HOT_ITEMS", 51), ("HOT_ENTITY_ITEMS", 60)):
        monkeypatch.setattr(RC, name, limit)
    assert export() == want


def test_items_of_parts_are_counted_in_their_document(tables):
    """Scores of documents in parts move no items."""
    people, tests, found = tables
    docs = RC.export_records(people, tests, found, max_tests=25, max_items=30)
    plan = N.score_records(docs, READY, S, F.lit("2019-01-01").cast("date"), RULES)._jdf.queryExecution().analyzed().toString()
    assert "explode(motTests" in plan and "defects AS d" not in plan and "explode(t#" not in plan


def test_many_entities_settle_in_one_call(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "BUCKETS", 1)
    rows = [(f"E{k}", part, 2, 0, None) for k in range(50) for part in range(2 if k % 5 else 1)]
    spark.createDataFrame(rows, jobs.ARRIVAL).withColumn("arrived", F.lit("2020-01-01").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    jobs.run_available(jobs.settle_parts(spark.readStream.schema(jobs.ARRIVAL).parquet(str(tmp_path / "in")), 60), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["registration"] for r in got} == {f"E{k}" for k in range(50) if k % 5} and len(got) == 40
    assert all(r["complete"] and (r["n_seen"], r["n_parts"], r["batches"], r["parts"]) == (2, 2, [0], [0, 1]) for r in got)


def test_written_documents_are_compressed_and_their_shuffles_freed(tables, spark, tmp_path):
    """The disk holds neither plain JSON nor, once the files are there, what was shuffled to build them."""
    import time

    people, tests, found = tables
    docs = RC.export_records(people, tests, found, max_tests=25, max_items=30, max_document_items=60)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {n for n in disk.getAllFiles().mkString("|").split("|") if "/shuffle_" in n}
    before = shuffled()
    RC.write_records(docs, str(tmp_path / "in"))
    for _ in range(40):
        if not (left := shuffled() - before):
            break
        time.sleep(0.5)
    assert not left
    assert {p.name.partition(".")[2] for p in (tmp_path / "in").glob("part-*")} == {"json.gz"}
    rows = lambda df: sorted((r["registration"], r["part"], r["n_parts"], str(r["motTests"])) for r in df.collect())
    assert rows(RC.read_records(spark, str(tmp_path / "in"))) == rows(docs)


def test_documents_of_listed_entities(tables, spark):
    people, tests, found = tables
    keys = spark.createDataFrame([("HOT",), ("K1",), ("EMPTY",)], "registration string")
    docs = lambda *t: sorted(map(str, RC.export_records(*t, max_tests=40, max_items=50).collect()))
    every = RC.export_records(people, tests, found, max_tests=40, max_items=50).join(keys, "registration", "left_semi")
    assert docs(*RC.of_entities(people, tests, found, keys, 3)) == sorted(map(str, every.collect()))
