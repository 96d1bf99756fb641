"""Schemas, table readers and writers."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from erisk.operators.quality import counted

ENTITY_SCHEMA = "registration string, make string, model string, first_used_date date, " \
                "registration_date date, fuel_type string, engine_size double"
EVENT_SCHEMA = "mot_test_number string, registration string, completed_date timestamp, test_result string, " \
               "odometer_value double, odometer_unit string, odometer_result_type string, expiry_date date, " \
               "data_source string"
ITEM_SCHEMA = "mot_test_number string, type string, text string, dangerous boolean"

FEATURE_SCHEMA = "registration string, mot_test_number string, test_date date, target_failed bigint, make string, " \
                 "fuel_type string, age_years double, n_prior_cycles bigint, n_prior_fails bigint, " \
                 "fails_last_3 bigint, prev_odometer double, prev_fail_items bigint, prev_advisories bigint, " \
                 "days_since_prev bigint, annual_miles_last_interval double"

DEFECT = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()),
                       T.StructField("dangerous", T.BooleanType())])
TEST = T.StructType([T.StructField(n, T.StringType()) for n in (
    "motTestNumber", "completedDate", "testResult", "odometerValue", "odometerUnit", "odometerResultType",
    "expiryDate", "dataSource")] + [T.StructField("defects", T.ArrayType(DEFECT))])
RECORD_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in (
    "registration", "make", "model", "firstUsedDate", "registrationDate")] +
    [T.StructField("motTests", T.ArrayType(TEST))] +
    [T.StructField(n, T.IntegerType()) for n in ("part", "n_parts")])   # absent in ordinary documents


def read_table(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Any file source; a missing path raises when the plan is built."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int,
              **options) -> DataFrame:
    """S1 over JDBC, split by a numeric key so no single task reads the table."""
    return (spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low,
                                              upperBound=high, numPartitions=parts, **options).load())


def one_entity(events: DataFrame, key: str) -> DataFrame:
    """Ordered history of one entity (the filter reaches the scan)."""
    return events.where(F.col("registration") == key).orderBy("completed_date")


def read_features_csv(spark: SparkSession, path: str, schema: str = FEATURE_SCHEMA) -> DataFrame:
    """S3: explicit schema, so labels such as 'E' or '0' stay text."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_features_csv(df: DataFrame, path: str) -> None:
    """S4. An empty table is an error."""
    counted(df, path, lambda d: d.write.mode("errorifexists").option("header", True).csv(path))


def write_features(df: DataFrame, path: str) -> None:
    """S4 at scale: Parquet by year of the target date, so date splits prune files. An empty table is an error."""
    counted(df.withColumn("test_year", F.year("test_date")), path, lambda d: d.write.mode("errorifexists").partitionBy("test_year").parquet(path))


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """S4 for source tables read again and again: events and items bucketed by event id join without a shuffle."""
    writer = df.write.mode("errorifexists").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def write_report(df: DataFrame, path: str, order=()) -> None:
    """A report as CSV: one sorted part if an order is given (reports are small), else as many as the table has."""
    out = df.orderBy(*order).coalesce(1) if order else df
    out.write.mode("errorifexists").option("header", True).csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """A rendered report; ``lines`` has (position, line) and a few dozen rows."""
    lines.orderBy("position").select("line").coalesce(1).write.mode("errorifexists").text(path)


def query(spark: SparkSession, sql: str, **params) -> DataFrame:
    """Named parameters, never spliced text."""
    return spark.sql(sql, args=params)


def register_functions(spark: SparkSession, rules, sample_pct: int) -> None:
    """The three scalar functions for SQL users, as SQL expressions the optimiser can see through."""
    quote = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    pairs = ", ".join(f"{quote(k)}, {quote(v)}" for k, v in rules.merges.items())
    label = "UPPER(BTRIM(v, ' \\t\\n\\r'))"
    merged = f"TRY_ELEMENT_AT(MAP({pairs}), {label})" if pairs else "CAST(NULL AS STRING)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION clean_make(v STRING) RETURNS STRING "
              f"RETURN COALESCE({merged}, NULLIF({label}, ''), 'UNKNOWN')")
    chunk = lambda i: f"CAST(CONV(SUBSTRING(MD5(COALESCE(k, '')), {8 * i + 1}, 8), 16, 10) AS BIGINT)"
    fold = "0L"
    for i in range(4):
        fold = f"(({fold}) * 96 + {chunk(i)}) % 100"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION in_sample(k STRING) RETURNS INT "
              f"RETURN CAST(({fold}) < {int(sample_pct)} AS INT)")
    name = "COALESCE(UPPER(BTRIM(m, ' \\t\\n\\r')), '')"
    in_list = lambda words: ", ".join(quote(w) for w in words)
    whens = f"WHEN clean_make(v) IN ({in_list(rules.excluded)}) THEN 0 " if rules.excluded else ""
    for key, words in rules.allowed_first_words.items():
        whens += f"WHEN clean_make(v) = {quote(key)} THEN CAST(SPLIT_PART({name}, ' ', 1) IN ({in_list(words)}) AS INT) "
    for key, pattern in rules.denied_patterns.items():
        whens += (f"WHEN clean_make(v) = {quote(key)} THEN CAST({name} NOT IN ({in_list(rules.unknown_models)}) "
                  f"AND NOT {name} RLIKE {quote(pattern)} AS INT) ")
    body = f"CASE {whens}ELSE 1 END" if whens else "1"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION in_scope(v STRING, m STRING) RETURNS INT RETURN {body}")
