"""Nested records: one document per entity, both ways.

A document of a hot entity, or of an event with very many items, is written in parts so that no
task builds an unbounded array: ``part`` numbers the documents of an entity and ``n_parts`` counts
them. Ordinary entities have exactly one part. ``to_tables`` reads any number of parts back.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from erisk.functions.bands import order_of
from erisk.session import durable, freed_shuffles
from erisk.sources.tables import RECORD_SCHEMA

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso(column: str, dtype: str) -> Column:
    return F.date_format(column, STAMP) if dtype.startswith("timestamp") else F.col(column).cast("string")


MAX_BROADCAST = 100_000   # hot keys; beyond it every key takes the way that needs no list
# Beyond any of these a key is hot: its rows are dealt to several tasks. Smaller ones fit one task, in however many parts they go.
HOT_TESTS, HOT_ITEMS, HOT_ENTITY_ITEMS = 5_000, 5_000, 20_000
TEST_KEYS = ["motTestNumber", "completedDate", "testResult", "odometerValue", "odometerUnit", "odometerResultType",
             "expiryDate", "dataSource", "defects"]


def counted(hot: DataFrame) -> tuple[DataFrame, int]:
    """The hot keys as a durable list, and how many there are (counted up to just over MAX_BROADCAST)."""
    with freed_shuffles(hot.sparkSession):
        hot = durable(hot.select("*"))   # a new frame, as one keeps the setting it was made with
    return hot, hot.limit(MAX_BROADCAST + 1).count()


def few(df: DataFrame, n: int) -> DataFrame:
    """A table of at most ``n`` hot keys, broadcast if that is few; it then spares the rows of hot keys a shuffle by key."""
    return F.broadcast(df) if n <= MAX_BROADCAST else df


def split_hot(df: DataFrame, key: str, hot: DataFrame, n: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys); None where a side is not needed."""
    if n == 0:
        return df, None
    if n > MAX_BROADCAST:
        return None, df
    hot = F.broadcast(hot)
    return df.join(hot, key, "left_anti"), df.join(hot, key, "left_semi")


def both(whole: DataFrame | None, parts: DataFrame | None) -> DataFrame:
    return parts if whole is None else whole if parts is None else whole.unionByName(parts)


def defect_arrays(items: DataFrame, max_items: int, hot_events: DataFrame, n: int) -> DataFrame:
    """(event, chunk) -> array of items and its size. Copies of an item are counted before they are collected, and split into pieces of at
    most ``max_items``; a piece goes to a chunk by hash. Items of an ordinary event meet in one shuffle, by event; those of a
    hot one are counted and collected by (event, item) and (event, chunk)."""
    event, fields = "mot_test_number", ["type", "text", "dangerous"]
    plain, hot = split_hot(items, event, hot_events, n)

    def counted_copies(rows: DataFrame) -> DataFrame:
        return rows.groupBy(event, *fields).agg(F.count("*").alias("copies"))

    def in_pieces(copies: DataFrame) -> DataFrame:
        return (copies.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("copies") / max_items).cast("int") - 1)))
                .withColumn("copies", F.least(F.col("copies") - F.col("piece") * max_items, F.lit(max_items)))
                .withColumn("chunk", F.pmod(F.xxhash64(*fields, "piece"), F.col("chunks")).cast("int")))

    def collected(pieces: DataFrame) -> DataFrame:
        return pieces.groupBy(event, "chunk").agg(F.flatten(F.sort_array(F.collect_list(
            F.array_repeat(F.struct(*fields), F.col("copies").cast("int"))))).alias("defects"), F.sum("copies").alias("n_items"))

    chunks = F.ceil(F.sum("copies") / max_items).cast("int").alias("chunks")
    whole = parts = None
    if plain is not None and max_items >= HOT_ITEMS:
        whole = plain.groupBy(event).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("defects"), F.count("*").alias("n_items")) \
            .withColumn("chunk", F.lit(0))
    elif plain is not None:
        copies = counted_copies(plain.repartition(event))
        every = F.ceil(F.sum("copies").over(Window.partitionBy(event)) / max_items).cast("int")
        whole = collected(in_pieces(copies.withColumn("chunks", every)))
    if hot is not None:
        copies = counted_copies(hot)
        pieces = in_pieces(copies.join(few(copies.groupBy(event).agg(chunks), n), event))
        parts = collected(pieces.repartition(event, "chunk"))   # the join's own hashing would keep a hot event whole
    return both(whole, parts)


def of_entities(entities: DataFrame, events: DataFrame, items: DataFrame, keys: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of the listed entities (at most ``n``, one row each), cut at the scan before anything is shuffled."""
    keys = few(keys, n)
    events = events.join(keys, "registration", "left_semi")
    chosen, n_events = counted(events.select("mot_test_number").distinct())
    return entities.join(keys, "registration", "left_semi"), events, items.join(few(chosen, n_events), "mot_test_number", "left_semi")


def export_records(entities: DataFrame, events: DataFrame, items: DataFrame, max_tests: int = 5_000,
                   max_items: int = 5_000, max_document_items: int = 20_000) -> DataFrame:
    """Rebuild every entity's whole history, tests by date and number inside a document.

    Entities with more than ``max_tests`` events, ``max_document_items`` items or an event of more than ``max_items`` items
    become documents in parts, of about that size each. Only what is too large for one task as well (``HOT_TESTS``,
    ``HOT_ITEMS``, ``HOT_ENTITY_ITEMS``) is dealt by part; items and tests of all others are shuffled once each, however
    low the limits are. Entity attributes meet a part on (entity, part), so no task holds all parts of a hot entity.
    """
    types = dict(events.dtypes)
    no_items = F.array().cast("array<struct<type:string,text:string,dangerous:boolean>>")
    per_event = items.groupBy("mot_test_number").agg(F.count("*").alias("__items"))
    sizes = events.select("registration", "mot_test_number").join(per_event, "mot_test_number", "left") \
        .groupBy("registration").agg(F.count("*").alias("__tests"), F.sum("__items").alias("__items"),
                                     F.max("__items").alias("__most"))
    most_tests, most_items, most_in_one = max(max_tests, HOT_TESTS), max(max_document_items, HOT_ENTITY_ITEMS), max(max_items, HOT_ITEMS)
    large = (F.col("__tests") > most_tests) | (F.col("__items") > most_items) | (F.col("__most") > most_in_one)
    hot_entities, n_entities = counted(sizes.where(large).select("registration"))
    hot_events, n_events = counted(per_event.where(F.col("__items") > most_in_one).select("mot_test_number"))
    tests = events.join(defect_arrays(items, max_items, hot_events, n_events), "mot_test_number", "left").select(
        "registration", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.struct(iso("completed_date", types["completed_date"]).alias("completedDate"),
                 F.col("mot_test_number").cast("string").alias("motTestNumber"),
                 F.col("test_result").alias("testResult"),
                 F.col("odometer_value").cast("string").alias("odometerValue"),
                 F.col("odometer_unit").alias("odometerUnit"),
                 F.col("odometer_result_type").alias("odometerResultType"),
                 F.col("expiry_date").cast("string").alias("expiryDate"),
                 F.upper(F.coalesce("data_source", F.lit(""))).alias("dataSource"),
                 F.coalesce("defects", no_items).alias("defects")).alias("test"))
    in_order = F.transform(F.sort_array(F.collect_list("test")), lambda t: F.struct(*[t[k].alias(k) for k in TEST_KEYS]))
    plain, hot = split_hot(tests, "registration", hot_entities, n_entities)
    low = max_tests < HOT_TESTS or max_document_items < HOT_ENTITY_ITEMS or max_items < HOT_ITEMS   # ordinary keys in parts

    def sizes_in_parts(rows: DataFrame) -> DataFrame:
        return rows.groupBy("registration").agg(F.greatest(
            F.ceil(F.count("*") / max_tests), F.ceil(F.sum("n_items") / max_document_items),
            F.max("chunk") + 1).cast("int").alias("n_parts"))   # an event in chunks is never in one whole document

    def numbered(rows: DataFrame, n_parts: DataFrame) -> DataFrame:
        return rows.join(n_parts, "registration").withColumn(
            "part", F.pmod(F.xxhash64("test.motTestNumber", "chunk"), F.col("n_parts")).cast("int"))

    def collected(rows: DataFrame) -> DataFrame:
        return rows.groupBy("registration", "part").agg(in_order.alias("motTests"))

    whole = parts = n_parts = None
    if plain is not None and not low:
        whole = plain.groupBy("registration").agg(in_order.alias("motTests")).select("registration", F.lit(0).alias("part"), "motTests")
    elif plain is not None:
        n_parts = sizes_in_parts(plain)
        whole = collected(numbered(plain, n_parts))   # the join's shuffle by entity serves the grouping as well
    if hot is not None:
        rows = few(durable(sizes_in_parts(hot)), n_entities)
        parts = collected(numbered(hot, rows).repartition("registration", "part"))
        n_parts = both(n_parts, rows)
    people = entities.withColumn("n_parts", F.lit(1))
    if n_parts is not None:
        people = entities.join(n_parts, "registration", "left").withColumn("n_parts", F.coalesce("n_parts", F.lit(1)))
    numbers = F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1))   # a part may be empty; it is written all the same
    no_tests = F.array().cast(RECORD_SCHEMA["motTests"].dataType)
    return people.withColumn("part", numbers).join(both(whole, parts), ["registration", "part"], "left").select(
        F.col("registration").cast("string").alias("registration"), "make", "model",
        F.col("first_used_date").cast("string").alias("firstUsedDate"),
        F.col("registration_date").cast("string").alias("registrationDate"),
        F.coalesce("motTests", no_tests).alias("motTests"), "part", "n_parts")


def read_records(spark, path: str, stream: bool = False) -> DataFrame:
    """JSON lines, one document per line; the same schema for batch and stream."""
    return (spark.readStream if stream else spark.read).schema(RECORD_SCHEMA).json(path)


def write_records(records: DataFrame, path: str) -> None:
    """Documents as compressed JSON lines. A file is what one task built, so it is read by one task as well."""
    with freed_shuffles(records.sparkSession):
        records.write.option("compression", "gzip").json(path)


def parse_records(df: DataFrame, column: str) -> DataFrame:
    """S10 for documents that arrive as text in a column."""
    return df.select(F.from_json(column, RECORD_SCHEMA).alias("r")).select("r.*")


def to_tables(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three plain tables of any set of documents; parts of one entity or one event are merged."""
    entities = records.groupBy("registration").agg(*[
        F.first(c, ignorenulls=True).alias(n) for c, n in (
            ("make", "make"), ("model", "model"), ("firstUsedDate", "first_used_date"),
            ("registrationDate", "registration_date"))]) \
        .withColumn("fuel_type", F.lit(None).cast("string")).withColumn("engine_size", F.lit(None).cast("double"))
    tests = records.select("registration", F.explode("motTests").alias("t"))
    events = tests.select(
        F.col("t.motTestNumber").alias("mot_test_number"), "registration", F.col("t.completedDate").alias("completed_date"),
        F.col("t.testResult").alias("test_result"), F.col("t.odometerValue").alias("odometer_value"),
        F.col("t.odometerUnit").alias("odometer_unit"), F.col("t.odometerResultType").alias("odometer_result_type"),
        F.col("t.expiryDate").alias("expiry_date"), F.col("t.dataSource").alias("data_source")).distinct()
    items = tests.select(F.col("t.motTestNumber").alias("mot_test_number"), F.explode("t.defects").alias("d")) \
        .select("mot_test_number", "d.*")
    return entities, events, items


def write_cases(cases: DataFrame, path: str) -> None:
    """Input record and expected values, one JSON line per case."""
    cases.write.mode("errorifexists").json(path)


CASE_SCHEMA = ("`group` string, target_date date, vehicle " + RECORD_SCHEMA.simpleString() +
               ", expected struct<features:map<string,double>,make:string,probability:double,band:string>")


def read_cases(spark, path: str) -> DataFrame:
    return spark.read.schema(CASE_SCHEMA).json(path)


def chart_document(points: DataFrame, order, meta: dict[str, Column]) -> DataFrame:
    """One JSON text: metadata and the series in fixed group order (a few hundred points)."""
    point = F.struct("age", "tests", "fails", "fail_pct", "ci_low", "ci_high")
    series = points.groupBy("generation").agg(F.sort_array(F.collect_list(point)).alias("points"),
                                              F.sum("tests").alias("__tests"))
    ordered = F.transform(
        F.sort_array(F.collect_list(F.struct(order_of("generation", order).alias("o"), "generation", "points"))),
        lambda s: F.struct(s["generation"].alias("generation"), s["points"].alias("points")))
    return series.agg(F.sum("__tests").alias("total_tests"), ordered.alias("series")).select(
        F.to_json(F.struct(F.struct(*[c.alias(k) for k, c in meta.items()], F.col("total_tests")).alias("meta"),
                           F.col("series"))).alias("document"))
