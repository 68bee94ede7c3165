"""Registered queries against their oracle SQL on the smallest tables; all of them with KICKFRAME_ALL=1."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from check_queries import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
QUICK = [
    "best_market_from_form", "pressure_form", "league_profile", "head_to_head", "asof_state", "odds_tolerance_join", "date_vote", "picks",
    "market_book", "settlement", "threshold_scan", "calibration_error", "elo_series", "odds_payloads", "stream_windows", "prediction_health",
    "stats_join_deduped", "tiered_stats_join", "odds_fill", "alias_suggestions", "fuzzy_fixture_match", "team_ratios", "value_metrics", "first_upcoming", "league_combiner", "kernel_similarity",
]
NAMES = sorted(queries()) if os.environ.get("KICKFRAME_ALL") else QUICK

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    got = queries()[name](spark, SF).toPandas()
    if name in oracle_sql():
        assert compare(got, connect(SF).execute(oracle_sql()[name]).df()) == ""
