"""Plan shape: what must hold at any size."""
import re

import pytest

from workload import roles as W
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
MODELS = {"fit_logistic", "platt", "train_scores", "validation_gates", "pilot_scores", "permutation_importance", "fit_one_feature",
          "stream_score", "stream_session_cycles"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["cycle_features", "cycle_features_text", "auc_by_segment", "nested_features", "peer_rank_rows",
                                  "spearman_matrix", "chart_rate_by_age_group", "rule_agreement", "batch_session_cycles"])
def test_no_python_no_cross_join(spark, no_broadcast, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "ObjectHashAggregate [percentile"):
        assert word not in plan, word


def test_feature_table_shuffles(spark, no_broadcast):
    """Events move three times: (entity, day), event id, entity. Entities and item counts once each."""
    plan = plan_of(W.features(spark, SF))
    moves = [re.sub(r"#\d+", "", m) for m in re.findall(r"Exchange hashpartitioning\(([^)]*?), 2\)", plan)]
    assert sorted(moves) == sorted(["registration, d", "mot_test_number", "mot_test_number", "registration", "registration",
                                    "c_nationkey", "n_nationkey"])
    assert "SinglePartition" not in plan
    assert plan.count("WindowGroupLimit") == 2          # before and after the (entity, day) shuffle
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in plan      # no item text is read
    assert "LessThan(o_orderdate," in plan              # the snapshot end reaches the scan


def test_single_partition_only_on_totals(spark, no_broadcast):
    """An exchange to one partition carries aggregates or block totals, never rows."""
    for name in ("auc_overall", "calibration_summary", "odds_step_table", "table_totals"):
        plan = plan_of(QUERIES[name](spark, SF))
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "SinglePartition" in line:
                below = next(x for x in lines[i + 1:] if "Project" not in x)
                assert "Aggregate" in below, (name, below)


def test_hot_text_items_never_join_before_counting(spark, no_broadcast):
    plan = plan_of(W.text_features(spark, SF))
    assert re.search(r"HashAggregate\(keys=\[mot_test_number#\d+\].*partial_count", plan)
