"""Wall time of the registered queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated, default: headline list).
"""
from __future__ import annotations

import json
import os
import sys
import time

from workload.check import session
from workload.queries import QUERIES

HEADLINE = ["cycle_features", "cycle_features_text", "flagged_history", "chart_rate_by_age_group", "hash_sample_entities",
            "scope_and_normalise", "safety_net", "rule_agreement", "item_categories", "document_topics", "rate_by_bands",
            "rate_pivot", "group_total_lift", "baseline_lookup", "peer_rank_rows", "band_share_by_age", "model_score",
            "contributions", "auc_overall", "auc_by_segment", "roc_points", "brier_logloss", "calibration_deciles", "psi_score",
            "preprocessing_stats", "band_cutoffs", "univariate_summary", "spearman_matrix", "sample_pools",
            "nested_history_export", "nested_features", "parity_mismatches", "record_scores", "batch_session_cycles",
            "stream_session_cycles", "fit_logistic", "bootstrap_auc", "train_scores",
            "validation_gates", "permutation_importance", "pilot_scores", "record_scores_parts", "stream_score"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    QUERIES["cycle_features"](spark, sf).write.format("noop").mode("overwrite").save()   # start-up is not measured
    times = {}
    for name in names:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
        print(f"{name:28s} {times[name]:7.2f}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
