"""Registered queries beside their SQL on the smallest tables.

``tools/compare.py`` runs all of them; this picks at least one per group.
"""

from __future__ import annotations

import pytest
from compare import connect, difference

import __spark_entry__ as entry_points
from blocktrace.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
CHOSEN = ["src1_read_msr", "src8_check_predictions", "src10_verify_checksums", "cln2_reject_reasons", "cln7_normalize",
          "agg1_parse_counters", "agg3_disorder_counts", "agg9_interval_summary", "agg14_write_rate",
          "agg15_interval_ecdf", "agg17_lorenz_curve", "win1_intervals_with_ties", "win3_build_sequences",
          "win5_split_with_ties", "win10_rule_statistic", "fn4_window_features", "fn14_device_segments",
          "ev4_score_predictors", "ev13_spearman", "jn1_repeated_keys", "jn2_prediction_audit", "pl3_placement_counters",
          "src7_typed_trace", "pc1_ablation", "pc3_policy_summary", "au2_broken_accounting",
          "au5_unfair_comparison", "au8_bad_model_records", "e1_raw_to_statistics", "ev10_trace_quality", "ev11_training_sets", "sel2_assign_roles", "st2_rule_temperature_stream",
          "st3_assign_predictions_stream", "st5_disorder_stream"]


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, connection, name):
    assert difference(spark, connection, FOLDER, name) is None
    spark.catalog.clearCache()


def test_entry_points(spark):
    assert set(SQL) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(QUERIES) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() == 5
