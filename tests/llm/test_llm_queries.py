"""Registered queries against their SQL twins, and the pipeline against its stages one by one."""
import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from erisk.llm import queries
from workload.check import rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, cur = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns) and rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("*")
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, SF).collect()
        new = {r["doc_id"] for r in left}
        assert new < ids or name == "quality_rules" and new <= ids
        assert len(left) == len(new)
        docs, ids = docs.filter(docs["doc_id"].isin(list(new))), new
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    assert packed == ids


def test_pipeline_as_a_whole(spark, tmp_path, hard_texts):
    """Null, empty, repeated and very long rows, extra columns and an empty table through run()."""
    docs, own = spark.read.parquet(f"{SF}/documents.parquet"), [f"x{k}" for k in range(3)]
    hard = spark.createDataFrame([(10_000 + k, t, None, None, 0) for k, t in enumerate(hard_texts)] + [(None, None, None, None, None)], docs.schema)
    table = docs.union(docs.limit(9)).union(hard)
    for name in ["row", "key", "d", "size", *own]:
        table = table.withColumn(name, table["doc_id"])
    for folder, rows in (("some", table), ("none", table.limit(0))):
        rows.write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        for name in ("labels", "benchmark"):
            source = spark.read.parquet(f"{SF}/{name}.parquet")
            (source if folder == "some" else source.limit(0)).write.parquet(f"{tmp_path}/{folder}/{name}.parquet")
    plain = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/some").select("doc_id").collect()}
    assert {k for k in got if k is not None and k < 10_000} >= plain - {None} and not got & {None, 10_000, 10_001, 10_002, 10_003}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
