"""Hand-built bars: a pattern, the same shape after the wrong trend, and boundaries; invariants."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import indicators as I
from tidemark.operators import patterns as P


def bars(spark, rows, symbol="T"):
    start = datetime.datetime(2020, 1, 6)
    data = [(symbol, "1wk", start + datetime.timedelta(weeks=i), *map(float, r), 100) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "symbol string, interval string, ts timestamp, open double, high double, low double, close double, volume long")


def found(spark, rows):
    df = P.detected(P.prepared(bars(spark, rows), "1wk"), hold=False)
    return {(r.pattern, r.direction) for r in df.filter(F.col("idx") == len(rows)).collect()}


DOWN = [(120 - 4 * i, 121 - 4 * i, 115 - 4 * i, 116 - 4 * i) for i in range(6)]
UP = [(80 + 4 * i, 85 + 4 * i, 79 + 4 * i, 84 + 4 * i) for i in range(6)]


def test_engulfing_needs_its_trend(spark):
    swallow = [(97, 98, 94, 95), (94.5, 99, 94, 98)]
    assert ("BULLISH_ENGULFING", "BUY") in found(spark, DOWN + swallow)
    assert ("BULLISH_ENGULFING", "BUY") not in found(spark, UP + swallow)
    short = [(97, 98, 94, 95), (94.5, 99, 94, 96.9)]
    assert ("BULLISH_ENGULFING", "BUY") not in found(spark, DOWN + short)


def test_hammer_and_hanging_man(spark):
    hammer = (95, 95.4, 90, 95.5 - 0.1)
    assert ("HAMMER", "BUY") in found(spark, DOWN + [(95, 96.1, 90, 96)])
    assert ("HANGING_MAN", "SELL") in found(spark, UP + [(105, 106.1, 100, 106)])
    assert found(spark, DOWN + [hammer]) <= {("HAMMER", "BUY")}


def test_lifecycle_equality_resolves_nothing(spark):
    rows = DOWN + [(97, 98, 94, 95), (94.5, 99, 94, 98), (98, 99.5, 95, 99), (99, 99.2, 95, 94), (96, 99, 94, 98)]
    b = bars(spark, rows)
    s = B.lifecycle_init(P.detected(P.prepared(b, "1wk"), ("BULLISH_ENGULFING",)))
    r = B.lifecycle_resolve(s, I.indexed(b)).first()
    assert (r.trigger, r.invalidation, r.status, r.resolution_offset) == (99.0, 94.0, "EXPIRED", 3)


def test_linear_series_has_its_averages(spark):
    rows = [(i - 0.5, i + 1, i - 1, i) for i in range(1, 60)]
    last = I.enrich(bars(spark, rows), "1wk").orderBy(F.desc("ts")).first()
    assert last.sma_long == sum(range(20, 60)) / 40
    assert last.rsi == 100.0
    assert last.value_low <= last.poc <= last.value_high
