"""The historical scan against a loop over bars."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import backtest as B


def plain(bars, signals, lookback, fwd, move, window):
    out = []
    for at, pattern, side, size in signals:
        if side == "HOLD" or at < len(bars) - lookback:
            continue
        form = bars[max(0, at - size + 1) : at + 1]
        high, low = max(b[2] for b in form), min(b[3] for b in form)
        sign, trigger, edge = (1, high, low) if side == "BUY" else (-1, low, high)
        status, offset = "DETECTED", None
        for k, b in enumerate(bars[at + 1 : at + 1 + window], 1):
            offset = k
            if (b[1] - trigger) * sign > 0:
                status = "CONFIRMED"
            elif (edge - b[1]) * sign > 0:
                status = "INVALIDATED"
            elif k == window:
                status = "EXPIRED"
            if status != "DETECTED":
                break
        offset = offset if status != "DETECTED" else None
        left, entry = len(bars) - 1 - at, bars[at][1]
        if left < fwd:
            seen = ("PENDING", fwd - left, None, None, None)
        else:
            move_of = lambda p: (p - entry) / entry * 100
            up, down = max(b[2] for b in bars[at + 1 : at + fwd + 1]), min(b[3] for b in bars[at + 1 : at + fwd + 1])
            change = sign * move_of(bars[at + fwd][1])
            best, worst = (move_of(up), move_of(down)) if sign > 0 else (-move_of(down), -move_of(up))
            seen = ("SUCCESS" if change >= move else "FAILURE" if change <= -move else "INCONCLUSIVE", None, *(round(x, 9) for x in (change, best, worst)))
        out.append((bars[at][0], pattern, size, high, low, status, offset, bars[at + offset][0] if offset else None, *seen))
    out.sort(key=lambda x: x[1])
    return sorted(out, key=lambda x: x[0], reverse=True)


def test_scan_equals_a_loop(spark):
    r = random.Random(4)
    bars, price = [], 100.0
    for k in range(60):
        price = round(price * (1 + r.uniform(-0.04, 0.04)), 1)
        bars.append((datetime(2020, 1, 6) + timedelta(weeks=k), price, price + r.choice([0.0, 1.0, 3.0]), price - r.choice([0.0, 1.0, 3.0])))
    signals = [(k, p, s, n) for k in range(60) for p, s, n in (("B", "BUY", 1), ("A", "SELL", 3), ("C", "BUY", 2), ("D", "HOLD", 1)) if r.random() < 0.4 or k > 54]
    rows = [("X", "1wk", k + 1, t, c, h, low) for k, (t, c, h, low) in enumerate(bars)] + [("Y", "1wk", 1, *bars[0])]
    df = spark.createDataFrame(rows, "symbol string, interval string, idx long, ts timestamp, close double, high double, low double")
    df = B.scan_context(B.with_future(df, 4), 20)
    for k in range(3):
        df = df.withColumn(f"c{k}", F.lag(F.struct("high", "low"), k).over(B.W()))
    marked = spark.createDataFrame([("X", k + 1, p, s, n) for k, p, s, n in signals], "symbol string, idx long, pattern string, direction string, size int")
    joined = df.join(marked, ["symbol", "idx"])
    got = B.historical_scan(joined, 20, 4, 4.0).orderBy("place").collect()
    rounded = lambda x: None if x is None else round(x, 9)
    found = [(x.ts, x.pattern, x.formation_bars, x.formation_high, x.formation_low, x.status, x.resolution_offset, x.resolution_ts, x.outcome, x.remaining, *(rounded(v) for v in (x.directional_return, x.best_move, x.worst_move))) for x in got]
    want = plain(bars, signals, 20, 4, 4.0, 3)
    assert found == want and [x.place for x in got] == list(range(1, len(want) + 1))
    assert {x[5] for x in want} >= {"DETECTED", "CONFIRMED", "INVALIDATED"} and {x[8] for x in want} > {"PENDING"}
    assert B.historical_scan(joined.limit(0), 20, 4, 4.0).count() == 0
