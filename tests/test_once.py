"""Bars are made of the trades once a query: what is returned reads the written bars, not the trades."""

from tidemark.plans import alerts
from tidemark.sources import market as M

SF = "/root/testdata/sf0.001"


def test_bars_and_profile_feeds_do_not_read_trades_again(spark):
    for df in (M.bars(spark, SF), *alerts.feeds(spark, SF)[:2]):
        assert df.inputFiles() and not [f for f in df.inputFiles() if "lineitem" in f]
    fine = alerts.feeds(spark, SF)[2]
    assert not [f for f in fine.inputFiles() if "lineitem" in f]


def test_bars_are_grouped_from_one_shuffle_of_the_trades(spark, monkeypatch):
    """What is written first, of the trades, reads and shuffles them once; it holds groups and chunk ends alone."""
    plans, keep = [], M.written
    monkeypatch.setattr(M, "written", lambda df, kind: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, kind))
    for make in (M.bars, M.all_bars, M.finest_bars):
        plans.clear()
        make(spark, SF)
        first, *rest = plans
        assert first.count("lineitem.parquet") == 1 == first.count("hashpartitioning(symbol") and "chunk" in first
        assert not [p for p in rest if "lineitem" in p]
