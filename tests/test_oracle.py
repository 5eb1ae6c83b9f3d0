"""Registered queries against their SQL on another engine.

The default list keeps one or two queries per operator family; ORACLE_ALL=1 runs all.
"""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
CORE = """payload_typed_cast local_to_utc_dst interval_offset melt_zones temporal_completeness etl_rt_end_to_end dart_target holiday_proximity
lag_exact_time lag_rows rolling_same_hour vintage_pivot finalize_dataset noise_twin distribution_stats qq_fit ecdf_by_sign power_spectrum spectrogram
moving_window_stats rolling_autocorr sign_run_lengths elbow_point correlation_matrix class_distribution capital_ledger_ruin strategy_performance hourly_risk
weekly_accuracy_by_hour walk_forward_folds ols_per_hour ridge_per_hour lasso_per_hour walk_forward_predictions regression_metrics spike_metrics
classification_metrics bootstrap_oob_metrics consistent_features alpha_grid_summary""".split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ORACLE_ALL") else [n for n in CORE if n in entry.oracle_sql()]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    ok, note = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, note


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
