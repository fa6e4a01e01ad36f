"""Recursive averages by blocks against the plain recursion, over long histories."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import indicators as I
from tidemark.operators import recursive


def plain(values, alpha):
    y, out = values[0], []
    for x in values:
        y = y + alpha * (x - y)
        out.append(y)
    return out


def history(spark, series):
    rows = [(k, "1d", i, float(x)) for k, xs in series.items() for i, x in enumerate(xs)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "symbol string, interval string, n int, close double")
    return I.indexed(df.withColumn("ts", F.timestamp_seconds(F.col("n") * 86400)))


def close(got, want, largest=1.0):
    """To 1e-9, or to 1e-12 of the largest value where values cancel."""
    assert len(got) == len(want)
    assert max(abs(a - b) / max(1.0, abs(b), largest / 1000) for a, b in zip(got, want, strict=True)) <= 1e-9


@pytest.mark.parametrize("block", [1, 7, 512])
def test_equals_the_recursion(spark, monkeypatch, block):
    monkeypatch.setattr(recursive, "BLOCK", block)
    r = random.Random(7)
    walk = [100.0]
    for _ in range(4999 if block == 512 else 300):
        walk.append(max(0.5, walk[-1] + r.gauss(0, 1)))
    n = len(walk)
    series = {"walk": walk, "fall": [1e6] * (n // 2) + [100.0] * (n - n // 2), "signs": [r.choice([-1, 1]) * r.random() * 10 ** r.randint(-8, 8) for _ in range(n)], "one": [5.0]}
    alphas = {"a50": 2 / 51, "a21": 2 / 22, "a4": 0.4, "w14": 1 / 14, "fast": 2 / 3, "now": 1.0}
    df = recursive.with_averages(history(spark, series), {k: (F.col("close"), a) for k, a in alphas.items()})
    got = {}
    for x in df.orderBy("symbol", "ts").collect():
        got.setdefault(x.symbol, []).append(x)
    for k, xs in series.items():
        for name, a in alphas.items():
            close([x[name] for x in got[k]], plain(xs, a), 1e8 if k == "signs" else 1.0)


def test_old_bars_weigh(spark):
    """What lies 300 bars back still counts: 1e6 then 100, by an average of 50."""
    df = I.with_emas(history(spark, {"s": [1e6] * 300 + [100.0] * 300}), e=50)
    assert abs(df.orderBy(F.desc("ts")).first().e - plain([1e6] * 300 + [100.0] * 300, 2 / 51)[-1]) < 1e-6


def test_constant_prices_stay_constant(spark):
    df = history(spark, {"s": [0.1 + 0.2] * 1500})
    x = I.with_macd(I.with_emas(df, e=50), 12, 26, 9).orderBy(F.desc("ts")).first()
    assert (x.e, x.macd, x.macd_signal, x.macd_histogram) == (0.1 + 0.2, 0.0, 0.0, 0.0)


def test_plan_has_no_lists_of_bars(spark):
    plan = I.with_emas(history(spark, {"s": [1.0, 2.0]}), e=50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_factors_are_checked(spark):
    with pytest.raises(ValueError):
        recursive.with_averages(history(spark, {"s": [1.0]}), {"x": (F.col("close"), 0.9)})
    assert recursive.with_averages(history(spark, {"s": [1.0]}).limit(0), {"x": (F.col("close"), 0.5)}).count() == 0
