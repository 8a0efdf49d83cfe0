"""Every query with an SQL twin agrees with it; one representative per operator family runs here,
``tools/check_oracle.py`` runs all of them."""

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, duck

FAST = [
    "motion_segment", "c1_fill_nearest", "c2_fill_linear", "c4_mean_outliers_previous", "c9_carry_forward", "p1_numeric_coercion", "p24_candidate_stems",
    "w1_sliding_windows", "w8_moving_median", "w10_longest_run", "w12_window_quality", "w28_running_best", "w9_peak_tracking", "w26_post_motion_slew",
    "a1_error_stats_dual", "a8_lag_bounds", "a19_error_quartiles", "a20_signed_rank", "j2_linear_interpolation", "j6_interval_join", "j12_lag_join",
    "o4_rank_channels", "g9_lag_correlation", "g19_polynomial_detrend", "m3_nearest_neighbours", "s1_sensor_scan", "st1_live_motion_score",
]


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, sf, name):
    con = duck(sf)
    status, _, _, a, b = compare(spark, con, sf, name, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "ok", (status, a, b)


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
