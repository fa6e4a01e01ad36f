"""Chunked pivots against the sequential fold, on long random walks cut anywhere."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import pivots as P
from tidemark.operators import waves as V


def walk(n, seed, step=1.0):
    r = np.random.default_rng(seed)
    close = np.round(1000 + np.cumsum(r.normal(0, step, n)), 1)  # rounded: many ties
    high, low = np.round(close + np.abs(r.normal(0, 1, n)), 1), np.round(close - np.abs(r.normal(0, 1, n)), 1)
    high[r.random(n) < 0.02] += 30  # bars that turn on themselves
    return high, low, np.clip(np.round(close + r.normal(0, 0.5, n), 1), low, high)


def flat(n):
    return np.full(n, 5.0), np.full(n, 5.0), np.full(n, 5.0)


@pytest.mark.parametrize("chunk", [1, 3, 37, 500])
def test_chunk_tables_lead_where_the_fold_leads(chunk):
    """Entry to exit by table and turns by chunk, cut anywhere, against one chunk of all bars."""
    for seed in range(4):
        h, lo, c = walk(500, seed)
        reach = np.full(500, 2.5 + seed)
        whole = P.Chunk(1, h, lo, c, reach).turns(1, 1, float(h[0]), float(reach[0]), 1)
        state, got = (1, 1, float(h[0]), float(reach[0])), []
        for a in range(0, 500, chunk):
            part, i = P.Chunk(a + 1, *(x[a : a + chunk] for x in (h, lo, c, reach))), int(a == 0)
            got += part.turns(*state, i)
            after = part.from_entry(*state, i)
            if a:
                side, _, v, r = state
                e = next((x for x in part.table(side, True) if x[0] >= v), None)
                t = next((x for x in part.table(side, False) if v - x[0] >= r), None)
                first = min((x for x in (e, t) if x), key=lambda x: x[1], default=None)
                assert (first[2:] if first else state) == after
            state = after
        assert got == whole


def expected(series, sensitivities):
    out = []
    for name, (h, lo, c) in series.items():
        atr = np.full(len(h), 1.2)
        atr[:14] = np.nan
        vol, seen = V.volatility(h, lo, c, atr), set()
        for s in sensitivities:
            found = V.swings(h, lo, c, np.maximum(vol * s, np.abs(c) * 0.0125 * s))
            if len(found) >= 5 and tuple(found) not in seen:
                seen.add(tuple(found))
                out += [(name, s, k, i + 1, "HIGH" if g > 0 else "LOW", float(h[i] if g > 0 else lo[i])) for k, (i, g) in enumerate(found)]
    return sorted(out)


def table(spark, series):
    rows = [(k, "1d", i + 1, float(a), float(b), float(x), None if i < 14 else 1.2) for k, (h, lo, c) in series.items() for i, (a, b, x) in enumerate(zip(h, lo, c, strict=True))]
    df = spark.createDataFrame(rows, "symbol string, interval string, idx int, high double, low double, close double, atr double")
    return df.withColumn("ts", F.timestamp_seconds(F.col("idx") * 86400))


@pytest.mark.parametrize("chunk", [16, 250, 4096])
def test_pivots_equal_the_sequential_fold(spark, monkeypatch, chunk):
    monkeypatch.setattr(P, "CHUNK", chunk)
    late = tuple(np.concatenate([x, y]) for x, y in zip(flat(40), walk(300, 9), strict=True))
    series = {"a": walk(900, 1), "b": walk(900, 2, 8.0), "late": late, "flat": flat(60), "one": flat(1), "short": walk(20, 3, 30.0)}
    got = P.pivots(table(spark, series), (0.75, 1.25, 2.0, 3.0))
    assert sorted((x.symbol, x.sensitivity, x.seq, x.idx, x.kind, x.price) for x in got.collect()) == expected(series, (0.75, 1.25, 2.0, 3.0))


def test_long_history(spark):
    """100,000 bars in 25 chunks."""
    series = {"a": walk(100_000, 5, 3.0)}
    h, lo, c = series["a"]
    n = len(h)
    df = spark.range(n).select(F.lit("a").alias("symbol"), F.lit("1d").alias("interval"), (F.col("id") + 1).cast("int").alias("idx"))
    prices = spark.createDataFrame(__import__("pandas").DataFrame({"idx": np.arange(1, n + 1, dtype=np.int32), "high": h, "low": lo, "close": c, "atr": np.where(np.arange(n) < 14, np.nan, 1.2)}))
    df = df.join(prices, "idx").withColumns({"ts": F.timestamp_seconds(F.col("idx") * 60), "atr": F.nanvl("atr", F.lit(None).cast("double"))})
    got = P.pivots(df, (0.75, 2.0)).collect()
    assert sorted((x.symbol, x.sensitivity, x.seq, x.idx, x.kind, x.price) for x in got) == expected(series, (0.75, 2.0))
