"""Registered queries against their SQL twins, on the smallest given tables."""
import duckdb
import pytest

from workload.check import TABLES, compare
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
SOME = ["cycle_features", "cycle_features_text", "flagged_history", "chart_rate_by_age_group", "family_cycles", "scope_and_normalise",
        "safety_net", "rule_agreement_by_code", "rate_by_bands", "group_total_lift", "baseline_lookup", "peer_rank_rows",
        "auc_by_segment", "calibration_deciles", "psi_score", "band_cutoffs", "woe_iv", "univariate_summary", "spearman_matrix",
        "sample_pools", "nested_history_export", "record_scores", "batch_session_cycles", "stream_session_cycles", "platt"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_twin(spark, con, name):
    assert compare(spark, con, SF, name).endswith("ok")


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
