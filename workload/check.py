"""Run registered queries and compare them with their SQL twins in DuckDB.

    python -m workload.check [sf_dir] [name ...]
"""
from __future__ import annotations

import datetime
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from erisk.session import configure
from workload.oracle import ORACLE
from workload.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def session(cores: int = 8) -> SparkSession:
    spark = (configure(SparkSession.builder.master(f"local[{cores}]").appName("erisk"))
             .config("spark.sql.shuffle.partitions", str(cores)).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.12g}"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf: str, name: str) -> str:
    began = time.time()
    df = QUERIES[name](spark, sf)
    got = df.collect()
    took = time.time() - began
    if name not in ORACLE:
        return f"{name:28s} rows={len(got):6d} {took:5.1f}s  no oracle"
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"{name:28s} COLUMNS {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return f"{name:28s} rows={len(a):6d} {took:5.1f}s  ok"
    only_a, only_b = [x for x in a if x not in set(b)], [x for x in b if x not in set(a)]
    return (f"{name:28s} MISMATCH spark={len(a)} duckdb={len(b)} differing={len(only_a)}/{len(only_b)}\n"
            f"    columns {sorted(names)}\n    spark  {only_a[:3]}\n    duckdb {only_b[:3]}")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    spark, con = session(), duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name in chosen:
        try:
            line = compare(spark, con, sf, name)
        except Exception as e:   # report and go on to the next query
            line = f"{name:28s} ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += any(w in line for w in ("MISMATCH", "ERROR", "COLUMNS"))
        print(line, flush=True)
    print(f"{len(chosen) - bad}/{len(chosen)} fine")
    spark.stop()
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
