"""Wave signals: all windows of a chunk advanced together, against one window at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd

from tidemark.operators import elliott as L
from tidemark.operators import waves as V


def walk(seed, n, flat=False):
    r = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(r.normal(0, 0.03, n) * (0 if flat else 1)))
    high, low = close * (1 + r.random(n) * 0.02 * (not flat)), close * (1 - r.random(n) * 0.02 * (not flat))
    if not flat:  # ties and bars without a range
        close, high, low = (np.round(x, 0 if seed % 2 else 2) for x in (close, high, low))
    return high, low, close


def average_range(high, low, close):
    before = np.concatenate([[close[0]], close[:-1]])
    true = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    return pd.Series(true).ewm(alpha=1 / 14, adjust=False).mean().where(np.arange(len(true)) >= 14).to_numpy()


def plain(high, low, close, atr):
    """(now, sensitivity, kind, sign, turn, points), one bar after the other."""
    price, out = {1: high, -1: low}, set()
    for now in range(L.LEAST - 1, len(close)):
        a = max(0, now - L.WINDOW + 1)
        h, lo, c = high[a : now + 1], low[a : now + 1], close[a : now + 1]
        reach, seen = V.volatility(h, lo, c, atr[a : now + 1]), []
        for s in V.SENSITIVITIES:
            found = [(a + i, g) for i, g in V.swings(h, lo, c, np.maximum(reach * s, np.abs(c) * 0.0125 * s))]
            if len(found) < 5 or found in seen:
                continue
            seen.append(found)
            for kind, n in (("IMPULSE", 5), ("V", 5), ("C", 8)):
                for sign in (1, -1):
                    runs = [found[k : k + n] for k in (len(found) - n, len(found) - n - 1) if k >= 0 and found[k][1] == -sign]
                    if not runs:
                        continue
                    points = [i for i, _ in runs[0]]
                    last, turn = points[-1], None
                    if kind == "IMPULSE":
                        third = price[sign][points[3]] if sign > 0 else low[points[3]]
                        level = third * L.BREAKOUT if sign > 0 else third / L.BREAKOUT
                        turn = next((j for j in range(last + 1, now + 1) if (close[j] - level) * sign > 0), None)
                    elif last + 1 < now:
                        side = sign if kind == "V" else -sign
                        at = max(range(last + 1, now), key=lambda j: (price[side][j] * side, -j))
                        turn = next((j for j in range(at + 1, now + 1) if (close[j] - price[-side][j - 1]) * -side > 0), None)
                        points.append(at)
                    if turn is not None and now - turn <= L.PRESENT:
                        out.add((now + 1, s, kind, sign, turn + 1, tuple(i + 1 for i in points)))
    return out


def test_windows_equal_single_folds():
    for seed in range(6):
        high, low, close = walk(seed, 130)
        windows = [slice(max(0, k - 99), k + 1) for k in range(5, 130, 7)]
        pad = lambda x: np.array([np.concatenate([x[w], np.full(100 - len(x[w]), np.nan)]) for w in windows])
        reach = (high - low) * 2 + close * 0.01
        points, size, last = L.swing_windows(pad(high), pad(low), pad(close), pad(reach))
        for row, w in enumerate(windows):
            want = V.swings(high[w], low[w], close[w], reach[w])
            n = int(size[row])
            assert [(int(points[row, j]), int(last[row]) * (-1) ** (n - 1 - j)) for j in range(n)] == want


def test_present_counts_equal_one_window_at_a_time(spark, monkeypatch):
    series = {"A": walk(1, 420), "B": walk(2, 260), "F": walk(4, 150, flat=True), "S": walk(3, 20), "L": walk(5, L.LEAST)}
    rows, want = [], set()
    for symbol, (high, low, close) in series.items():
        atr = average_range(high, low, close)
        want |= {(symbol, *x) for x in plain(high, low, close, atr)}
        rows += [(symbol, "1d", i + 1, float(high[i]), float(low[i]), float(close[i]), None if np.isnan(atr[i]) else float(atr[i])) for i in range(len(close))]
    bars = spark.createDataFrame(rows, "symbol string, interval string, idx long, high double, low double, close double, atr double")
    for chunk in (120, 1000):
        monkeypatch.setattr(L, "CHUNK", chunk)
        got = L.present_counts(bars).collect()
        assert len(want) > 50 and {x[2] for x in want if x[0] == "A"}
        assert {(x.symbol, x.now, x.sensitivity, x.kind, 1 if x.direction == "BULLISH" else -1, x.turn, tuple(x[f"i{k}"] for k in range(9) if x[f"i{k}"] is not None)) for x in got} == want
        for x in got:
            high, low, _ = series[x.symbol]
            sign = 1 if x.direction == "BULLISH" else -1
            assert all(x[f"q{k}"] == sign * (low if (k % 2 == 0) == (sign > 0) else high)[x[f"i{k}"] - 1] for k in range(9) if x[f"i{k}"] is not None)
    assert L.present_counts(bars.limit(0)).count() == 0


def test_outcomes_and_their_statistics(spark):
    high, low, close = walk(8, 130)
    times = pd.date_range("2015-01-05", periods=130, freq="7D")
    bars = spark.createDataFrame([("A", "1wk", i + 1, times[i].to_pydatetime(), float(high[i]), float(low[i]), float(close[i])) for i in range(130)], "symbol string, interval string, idx long, ts timestamp, high double, low double, close double")
    asked = [(i, side, pattern, score) for i, side, pattern, score in ((98, "BUY", "X_WAVE_V_END", 90), (99, "BUY", "X_WAVE_V_END", 91), (100, "SELL", "X_CORRECTION", 76), (117, "SELL", "X_WAVE_V_END", 85), (118, "BUY", "X_CORRECTION", 99))]
    alerts = spark.createDataFrame([("A", "1wk", i + 1, times[i].to_pydatetime(), p, s, n) for i, s, p, n in asked], "symbol string, interval string, idx long, ts timestamp, pattern string, side string, score int")
    want, windows = {}, L.OUTCOMES["1wk"]
    for i, side, _pattern, _ in asked:
        if i + 1 < L.WINDOW or i + 12 >= 130:
            continue
        for n, m in windows:
            move = lambda p, i=i: (p - close[i]) / close[i] * 100 * (1 if side == "BUY" else -1)  # noqa: B023, E731
            ahead = slice(i + 1, i + n + 1)
            ends = sorted((move(high[ahead].max()), move(low[ahead].min())))
            change = move(close[i + n])
            want[times[i], n] = (times[i + n], round(change, 9), round(ends[1], 9), round(ends[0], 9), "SUCCESS" if change >= m else "FAILURE" if change <= -m else "INCONCLUSIVE")
    df = L.outcomes(alerts, bars, windows)
    rows = df.collect()
    assert {(pd.Timestamp(x.ts), x.horizon): (pd.Timestamp(x.exit_ts), round(x.close_return, 9), round(x.best_move, 9), round(x.worst_move, 9), x.outcome) for x in rows} == want and len(want) == 9
    stats = {(x.horizon, x.least, x.stage): x for x in L.outcome_stats(df).collect()}
    assert stats[4, 75, "ALL"].signals == 3 and stats[4, 80, "ALL"].signals == 2 and stats[4, 75, "C"].signals == 1 and (4, 80, "C") not in stats and stats[12, 90, "V"].signals == 1
    for (n, least, stage), x in stats.items():
        held = [r for r in rows if r.horizon == n and r.score >= least and (stage == "ALL" or r.pattern.endswith("CORRECTION") == (stage == "C"))]
        won, lost = (sum(r.outcome == o for r in held) for o in ("SUCCESS", "FAILURE"))
        assert (x.signals, x.successes, x.failures, x.inconclusive) == (len(held), won, lost, len(held) - won - lost)
        assert x.precision == (round(won * 100 / (won + lost), 6) if won + lost else None) and abs(x.average_close_return - sum(r.close_return for r in held) / len(held)) < 1e-5
    assert L.outcomes(alerts.limit(0), bars, windows).count() == 0
