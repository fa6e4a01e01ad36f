"""Every registered query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


#: One of each family; the driver compares all of them.
CHOSEN = [
    "ind_ema", "ind_rsi", "body_baseline", "prior_trend", "detect_patterns", "score_trend", "backtest_trades", "lifecycle_resolve", "scan_bars", "dedupe_logical_bars",
    "completed_bar_filter", "parse_score_reason", "changed_bars_upsert", "bars_from_array_json", "match_rules", "congress_fanout", "latest_close_asof", "ticker_search", "avp_bins", "daily_budget",
    "insider_fanout", "followed_trades", "candidate_rank", "archive_page", "stream_bars", "stream_dedupe", "stream_lifecycle", "stream_changed_bars", "stream_rule_match", "stream_fanout", "horizon_guidance",
    "load_adjusted_csv", "avp_select", "avp_freeze", "calibration_points", "observed_outcome", "signal_excursion", "write_trades", "write_signals",
    "ind_volume_profile", "setup_score", "threshold_sweep", "avp_value_area",
    "elliott_v2_score", "match_wave_rules", "wave_score_stats", "company_board", "latest_signals", "historical_scan", "load_universe",
]


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    r = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in r.description]
    want = sorted(repr([plain(row[names.index(c)]) for c in sorted(names)]) for row in r.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert got == want
