"""Every registered query against its SQL, and the series passes again with tiny blocks."""

import pytest

import __spark_entry__ as entry
from check_sql import compare, duck

QUERIES, SQL = entry.queries(), entry.oracle_sql()
BLOCKED = (
    "W2_running_max W3_cumulative_integral A19_episode_summary W6_min_gap_mask W7_min_gap_times W9_previous_row_blend W11_exponential_smoothing "
    "W12_attack_release W14_decaying_max W15_change_gated W16_stepped_tracking W17_hysteresis_servo W18_zero_crossing_near J12_compose_remaps "
    "J15_control_to_row_rate J24_convolution J24_multi_tap_echo W28_phase_progress A17_longest_hold"
).split()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    if name in SQL:
        # At the smallest scale a narrow filter may leave nothing on either side.
        assert compare(spark, con, sf_dir, QUERIES[name], SQL[name]) in (None, "empty on both sides")
    else:
        assert not QUERIES[name](spark, sf_dir).isEmpty()


@pytest.mark.parametrize("name", BLOCKED)
def test_query_over_many_blocks(spark, con, sf_dir, name):
    spark.conf.set("cuelattice.series.blockRows", "16")
    try:
        assert compare(spark, con, sf_dir, QUERIES[name], SQL[name]) is None
    finally:
        spark.conf.unset("cuelattice.series.blockRows")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registration_rejects_a_second_use_of_a_name():
    from cuelattice.plans.registry import query

    with pytest.raises(ValueError):
        query("W2_running_max")(lambda s, d: None)
