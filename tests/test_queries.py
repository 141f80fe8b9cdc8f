"""Registered queries against DuckDB on the given tables. PULSECHECK_ALL=1 runs every one of them."""

import os

import pytest

from workload.check import compare, connect
from workload.oracle import ORACLE
from workload.queries import REGISTERED

SF_DIR = "/root/testdata/sf0.001"
QUICK = [
    "scan_csv", "scan_two_tables", "split_by_time", "split_by_order", "split_train_holdout", "time_parse_share",
    "labels_complete", "infer_task_type", "target_candidates", "id_candidates", "constant_columns",
    "suggested_exclusions", "profile_summary", "duplicate_rows", "leakage_equality", "leakage_correlation",
    "quality_table", "quality_status", "type_changes", "missing_columns", "psi_bin_edges", "psi_histogram",
    "category_shares", "drift_table", "encode_multiclass", "unknown_predictions", "validate_probability",
    "impute_median", "impute_mode", "one_hot", "class_weights", "confusion_matrix", "performance_table",
    "regression_metrics", "roc_curve", "pr_curve", "calibration_curve", "calibration_assessment",
    "segment_columns", "segments_binary", "segments_multiclass", "segments_regression", "threshold_sweep",
    "threshold_improvement", "findings", "actions", "numeric_box", "numeric_histogram", "category_top_shares",
    "full_analysis_binary", "full_analysis_multiclass", "full_analysis_regression",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(REGISTERED)
    assert set(QUICK) <= set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE) if os.environ.get("PULSECHECK_ALL") else QUICK)
def test_agrees_with_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, name) == ""
