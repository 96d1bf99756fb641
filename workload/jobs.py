"""One command per stage, over the given tables:

    python -m workload.jobs STAGE SF_DIR OUT_DIR

STAGE: features, chart, univariate, train, validate, records, cases, score. Each reads its tables (or what an earlier stage
wrote under OUT_DIR) and writes files under OUT_DIR/STAGE, which must not exist.
"""
from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from erisk.operators import model as M, nested as N
from erisk.plans import chart, parity, training, univariate
from erisk.sources import models, records as RC, tables as T
from workload import queries as Q, roles as W
from workload.check import session

MODEL = "train/model"


def records(spark: SparkSession, sf: str) -> DataFrame:
    return RC.export_records(W.entities(spark, sf), W.events(spark, sf), W.items(spark, sf))


def build_features(spark: SparkSession, sf: str, out: str) -> None:
    T.write_features(W.features(spark, sf), f"{out}/features/all")
    T.write_features_csv(W.text_features(spark, sf), f"{out}/features/family_csv")


def features(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/features/all").drop("test_year")


def build_chart(spark: SparkSession, sf: str, out: str) -> None:
    points = chart.chart_points(W.entities(spark, sf), W.events(spark, sf), W.SETTINGS)
    T.write_report(points, f"{out}/chart/points", ["generation", "age"])
    RC.chart_document(points, W.SETTINGS.generation_order, {"source": F.lit("given tables")}).write.text(f"{out}/chart/document")


def build_univariate(spark: SparkSession, sf: str, out: str) -> None:
    done = univariate.analyse(features(spark, out), [*Q.COUNTS, *Q.SMOOTH], Q.CATEGORIES, W.SETTINGS)
    T.write_report(done.summary(), f"{out}/univariate/summary", ["feature"])
    T.write_report(done.bins, f"{out}/univariate/bins", ["feature", "bin"])
    T.write_report(done.by_year(), f"{out}/univariate/by_year", ["feature", "bin", "year"])


def build_model(spark: SparkSession, sf: str, out: str) -> None:
    done = training.train(features(spark, out), W.SETTINGS, W.SCOPE)
    models.save_model(spark, done.model, f"{out}/{MODEL}")
    T.write_report(done.scores, f"{out}/train/scores", ["score"])
    T.write_report(M.readable_units(spark, done.model), f"{out}/train/coefficients", ["feature"])


def validate(spark: SparkSession, sf: str, out: str) -> None:
    result = training.validate(features(spark, out), models.load_model(spark, f"{out}/{MODEL}"), W.SETTINGS)
    T.write_lines(training.report_lines(result), f"{out}/validate/report")
    T.write_report(result["segments"], f"{out}/validate/segments", ["dimension", "segment"])


def write_records(spark: SparkSession, sf: str, out: str) -> None:
    records(spark, sf).write.json(f"{out}/records/json")


def cases(spark: SparkSession, sf: str, out: str) -> None:
    model, pools = models.load_model(spark, f"{out}/{MODEL}"), Q.feature_pools()
    RC.write_cases(parity.build_cases(M.scored(features(spark, out), model), records(spark, sf), pools,
                                      {p: Q.SIZES[p] for p in pools}), f"{out}/cases/json")


def score(spark: SparkSession, sf: str, out: str) -> None:
    model = models.load_model(spark, f"{out}/{MODEL}")
    docs = RC.read_records(spark, f"{out}/records/json")
    N.score_records(docs, model, W.SETTINGS, F.current_date()).write.json(f"{out}/score/json")


STAGES = {"features": build_features, "chart": build_chart, "univariate": build_univariate, "train": build_model,
          "validate": validate, "records": write_records, "cases": cases, "score": score}


def main(args: list[str]) -> int:
    if len(args) != 3 or args[0] not in STAGES:
        print(__doc__, file=sys.stderr)
        return 2
    spark = session()
    STAGES[args[0]](spark, args[1], args[2].rstrip("/"))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
