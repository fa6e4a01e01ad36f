"""Wave signals of the bar that is current: breakouts of an impulse, ends of wave V,
ends of a correction, with their scores.

A signal looks at the last WINDOW bars only, so pivots are folded anew for every
bar: all windows of a chunk advance together, as vectors. Chunks overlap by a
window, which keeps a task small however long a symbol's history is. The fold
returns only counts whose turn is present; rules and scores are column expressions over their points and over the
bars joined by number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import waves as V

# Bars looked at, least bars, breakout beyond wave III, bars that a turn stays present.
WINDOW, LEAST, BREAKOUT, PRESENT = 100, 34, 1.003, 1
#: Least eligibility of an alert, and of a strong one.
ALERT, STRONG = 75, 85
# Bars held and the move that decides, by interval; least scores of the statistics.
OUTCOMES = {"1wk": ((4, 4.0), (8, 8.0), (12, 12.0)), "1mo": ((3, 6.0), (6, 12.0), (9, 18.0))}
SCORES = (75, 80, 85, 90)
#: Current bars of a task's chunk.
CHUNK = 1000
_POINTS = [f"{x}{k}" for k in range(9) for x in "qi"]  # turned prices and bar numbers of the points; null beyond the last
_FOUND = "symbol string, interval string, now long, sensitivity double, kind string, direction string, turn long, end_idx long, end_price double, third double, " + ", ".join(f"{c} {'double' if c[0] == 'q' else 'long'}" for c in _POINTS)


def swing_windows(high: np.ndarray, low: np.ndarray, close: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The swings of many windows (one a row; shorter ones end in NaN), advanced together bar by bar.

    Returns the pivots' columns per window (only the first `size` of a row count), size, and the
    sign of the last pivot; signs alternate. Each row equals `waves.swings` of that window."""
    n, width = high.shape
    every, mid = np.arange(n), (high + low) / 2
    side, top, bottom, best, size, last = (np.zeros(n, np.int64) for _ in range(6))
    points = np.zeros((n, width), np.int64)
    for i in range(1, width):
        h, lo, c, m = high[:, i], low[:, i], close[:, i], mid[:, i]
        fresh, up = side == 0, side == 1
        ahead, back, held = np.where(up, h, lo), np.where(up, lo, h), np.where(up, high[every, best], low[every, best])
        further = ~fresh & ((ahead - held) * side >= 0)
        best, held = np.where(further, i, best), np.where(further, ahead, held)
        turns = ~fresh & ((held - back) * side >= reach[every, best]) & ((best < i) | ((c - m) * side <= 0))
        before = points[every, size - 1]
        like = last == side
        better = turns & like & ((held - np.where(up, high[every, before], low[every, before])) * side > 0)
        points[better, size[better] - 1] = best[better]
        more = turns & ~like & (before != best)
        points[more, size[more]] = best[more]
        size, last = size + more, np.where(more, side, last)
        side, best = np.where(turns, -side, side), np.where(turns, i, best)
        # no leg yet: the first one begins once the extremes are far enough apart
        top, bottom = np.where(fresh & (h >= high[every, top]), i, top), np.where(fresh & (lo <= low[every, bottom]), i, bottom)
        begins = fresh & (high[every, top] - low[every, bottom] >= np.maximum(reach[every, top], reach[every, bottom]))
        rises = (bottom < top) | ((bottom == top) & (c >= m))
        points[begins, 0] = np.where(rises, bottom, top)[begins]
        side, best = np.where(begins, np.where(rises, 1, -1), side), np.where(begins, np.where(rises, top, bottom), best)
        size, last = np.where(begins, 1, size), np.where(begins, -side, last)
    return points, size, last


def window_volatility(high: np.ndarray, low: np.ndarray, close: np.ndarray, atr: np.ndarray) -> np.ndarray:
    """`waves.volatility` of many windows, one a row."""
    lacks = ~(atr > 0)
    before = np.concatenate([close[:, :1], close[:, :-1]], axis=1)
    true = np.maximum(np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before))), 1e-6)
    used, total = np.where(lacks, true, atr), np.zeros_like(atr)
    for k in range(14):
        total[:, k:] += used[:, : used.shape[1] - k]
    return np.where(lacks, total / np.minimum(np.arange(atr.shape[1]) + 1, 14), atr)


def _first(hit: np.ndarray) -> np.ndarray:
    """Column of each row's first True; -1 without one."""
    return np.where(hit.any(axis=1), hit.argmax(axis=1), -1)


def _turned(kind: str, sign: np.ndarray, points: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(turn, end) of each row's count: columns of the bar that turns and of the last point; turn -1 without one."""
    every, column, last = np.arange(len(now)), np.arange(high.shape[1]), points[:, -1]
    if kind == "IMPULSE":
        third = np.where(sign > 0, high[every, points[:, 3]], low[every, points[:, 3]])
        level = np.where(sign > 0, third * BREAKOUT, third / BREAKOUT)
        return _first((column > last[:, None]) & ((close - level[:, None]) * sign[:, None] > 0)), last
    # the extreme before the current bar; V of a rising count is a high, C a low
    side = (sign if kind == "V" else -sign)[:, None]
    open_ = (column > last[:, None]) & (column < now[:, None])
    at = np.where(open_, np.where(side > 0, high, -low), -np.inf).argmax(axis=1)
    edge = np.where(side > 0, low, high)
    behind = np.concatenate([np.full((len(now), 1), np.nan), edge[:, :-1]], axis=1)
    turn = _first((column > at[:, None]) & ((close - behind) * -side > 0))
    return np.where(open_.any(axis=1), turn, -1), at


def present_counts(enriched: DataFrame, sensitivities: tuple[float, ...] = V.SENSITIVITIES) -> DataFrame:
    """Counts whose turn is present, for every bar (now) of every symbol."""

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        idx = rows["idx"].to_numpy(np.int64)
        own = np.flatnonzero((idx >= int(rows["chunk"].iloc[0]) * CHUNK + 1) & (np.minimum(np.arange(len(idx)) + 1, WINDOW) >= LEAST))
        begin = np.maximum(0, own - WINDOW + 1)
        at = begin[:, None] + np.arange(WINDOW)
        inside = at <= own[:, None]
        high, low, close, atr = (np.where(inside, rows[c].to_numpy(float)[np.minimum(at, len(idx) - 1)], np.nan) for c in ("high", "low", "close", "atr"))
        reach, seen, out = window_volatility(high, low, close, atr), [], []
        for s in sensitivities:
            points, size, last = swing_windows(high, low, close, np.maximum(reach * s, np.abs(close) * 0.0125 * s))
            held = np.where(np.arange(WINDOW) < size[:, None], points, -1)
            signed = held * 2 + (last[:, None] > 0)  # with equal columns and sizes, the last sign tells all signs
            # the same pivots count once, for the smallest sensitivity
            again = np.zeros(len(own), bool)
            for other in seen:
                again |= (signed == other).all(axis=1)
            seen.append(signed)
            for n, kinds in ((5, ("IMPULSE", "V")), (8, ("C",))):
                for sign in (1, -1):
                    # the last n alternating pivots that begin with a low (sign 1) or a high
                    begins = np.where(last * (1 if n % 2 else -1) == -sign, size - n, size - n - 1)
                    ok = np.flatnonzero((size >= 5) & ~again & (size >= n) & (begins >= 0))
                    if not len(ok):
                        continue
                    pts = points[ok[:, None], begins[ok][:, None] + np.arange(n)]
                    h, lo, c, now = high[ok], low[ok], close[ok], own[ok] - begin[ok]
                    for kind in kinds:
                        turn, end = _turned(kind, np.full(len(ok), sign), pts, h, lo, c, now)
                        for k in np.flatnonzero((turn >= 0) & (now - turn <= PRESENT)).tolist():
                            cols = pts[k].tolist() + ([int(end[k])] if kind != "IMPULSE" else [])
                            # points alternate, from a low (sign 1) or a high
                            prices = [float((lo if (j % 2 == 0) == (sign > 0) else h)[k, i]) for j, i in enumerate(cols)]
                            flat = [x for i, p in zip(cols, prices, strict=True) for x in (p * sign, int(idx[begin[ok[k]] + i]))]
                            first = int(begin[ok[k]])
                            out.append((rows["symbol"].iloc[0], rows["interval"].iloc[0], int(idx[own[ok[k]]]), s, kind, "BULLISH" if sign > 0 else "BEARISH", int(idx[first + turn[k]]), int(idx[first + end[k]]), prices[-1], prices[3], *flat, *[None] * (18 - len(flat))))
        return pd.DataFrame(out, columns=["symbol", "interval", "now", "sensitivity", "kind", "direction", "turn", "end_idx", "end_price", "third", *_POINTS]).astype({c: "float64" if c[0] == "q" else "Int64" for c in _POINTS})

    own = F.floor((F.col("idx") - 1) / CHUNK)
    near = F.floor((F.col("idx") + WINDOW - 2) / CHUNK)  # the chunk whose first bar still sees this one
    dealt = enriched.select("symbol", "interval", "idx", "high", "low", "close", "atr", F.explode(F.array_distinct(F.array(own, near))).alias("chunk"))
    return dealt.groupBy("symbol", "interval", "chunk").applyInPandas(scan, _FOUND)


_BAR = ["ts", "open", "high", "low", "close", "volume", "ema_fast", "ema_slow", "sma_long", "average_volume", "rsi", "macd_histogram", "atr", "band_upper", "band_lower", "vwap"]


def with_bars(counts: DataFrame, enriched: DataFrame) -> DataFrame:
    """The bars a score looks at, by number: c (current), b (before), e (three before), t (last point), r (point III or A)."""
    compare = F.when(F.col("kind") == "C", F.col("i6")).otherwise(F.col("i3"))
    at = {"c": F.col("now"), "b": F.col("now") - 1, "e": F.col("now") - 3, "t": F.col("end_idx"), "r": compare}
    for name, where in at.items():
        bar = enriched.select("symbol", "interval", F.col("idx").alias("_at"), F.struct(*_BAR).alias(name))
        counts = counts.withColumn("_at", where).join(bar, ["symbol", "interval", "_at"], "left" if name == "e" else "inner").drop("_at")
    return counts


def follows() -> Column:
    """A turn stands on the current bar, or the current bar follows it through."""
    rises = _buys()
    more = F.when(rises, (F.col("c.close") >= F.col("b.close")) | (F.col("c.high") > F.col("b.high"))).otherwise((F.col("c.close") <= F.col("b.close")) | (F.col("c.low") < F.col("b.low")))
    level = F.col("third")
    still = F.when(F.col("kind") != "IMPULSE", True).when(rises, F.col("c.close") > level * BREAKOUT).otherwise(F.col("c.close") < level / BREAKOUT)
    return (F.col("turn") == F.col("now")) | (more & still)


def _buys() -> Column:
    return (F.col("direction") == "BULLISH") != (F.col("kind") == "V")


def signed(a: Column, b: Column) -> Column:
    """a beyond b in the signal's direction (false where one is missing)."""
    return F.coalesce(F.when(_buys(), a > b).otherwise(a < b), F.lit(False))


def valid() -> Column:
    return F.when(F.col("kind") == "IMPULSE", V.impulse_base()).when(F.col("kind") == "V", V.impulse_complete()).otherwise(V.correction_complete())


def _clamped(start: Column, points: list[Column]) -> Column:
    """Points added in order, the sum kept within 0 and 100 at each step."""
    return F.aggregate(F.array(*[F.coalesce(p, F.lit(0)).cast("int") for p in points]), start.cast("int"), lambda a, x: F.greatest(F.lit(0), F.least(F.lit(100), a + x)))


def _award(when: Column, points: int) -> Column:
    return F.when(when, points).otherwise(0)


def eligibility() -> Column:
    """Score of the first model: a base, zones and context, less what is unusual."""
    m, c, two, four = V.measures(), F.col("kind") == "C", V.TWO, V.FOUR
    rsi, bull = F.col("c.rsi"), F.col("direction") == "BULLISH"
    ahead = lambda x: F.coalesce(F.when(bull, F.col("c.close") > x).otherwise(F.col("c.close") < x), F.lit(False))
    surge = _award(F.col("c.volume") > F.col("c.average_volume") * 1.2, 5)
    turned = F.when(bull, F.col("c.ema_fast") > F.col("e.ema_fast")).otherwise(F.col("c.ema_fast") < F.col("e.ema_fast"))
    span = V._i(5) - V._i(0)
    truncated = _award(V._p(5) <= V._p(3), -V.TRUNCATION)
    unusual = [-V.two_penalty(m["two"]), -V.three_penalty(m["three_to_one"]), -V.four_penalty(m["four"])]
    impulse = [
        F.when(m["two"].between(two[0], two[3]), 5).otherwise(unusual[0]), _award(m["two"].between(two[1], two[2]), 5),
        F.when(m["three"] >= m["one"], 10).otherwise(unusual[1]),
        F.when(m["four"].between(four[0], four[3]), 5).otherwise(unusual[2]), _award(m["four"].between(four[1], four[2]), 5),
        _award(ahead(F.col("c.ema_fast")), 7), _award(turned, 5), _award(F.when(bull, rsi.between(45, 72)).otherwise(rsi.between(28, 55)), 5), surge,
        # a developing impulse still lacks its last leg
        F.when(F.col("kind") == "V", -V.span_penalty(span)).otherwise(-V.span_penalty(V._i(4) - V._i(0) + V.LEG)),
        F.when(F.col("kind") == "V", truncated).otherwise(0),
    ]
    normal = m["c_to_a"].between(V.C_TO_A[0], V.C_TO_A[3])
    correction = [
        F.when(m["back"].between(*V.CORRECTION), 8).otherwise(-V.back_penalty(m["back"])), _award(m["back"].between(0.382, 0.618), 8),
        F.when(normal, 5).otherwise(-V.c_to_a_penalty(m["c_to_a"])), _award(m["c_to_a"].between(V.C_TO_A[1], V.C_TO_A[2]), 5), -V.variant_penalty(V.variant()),
        _award(ahead(F.col("c.ema_fast")), 7), _award(F.when(bull, rsi.between(40, 68)).otherwise(rsi.between(32, 60)), 5), surge,
        *unusual, -V.span_penalty(span), truncated,
    ]
    return F.when(c, _clamped(F.lit(62), correction)).otherwise(_clamped(F.lit(60), impulse))


def _shortest(n: int) -> Column:
    return F.array_min(F.array(*[V._i(k) - V._i(k - 1) for k in range(1, n + 1)]))


def families() -> dict[str, Column]:
    """Points of the second model's seven families (for V and C), each with its most."""
    m, c, two, four = V.measures(), F.col("kind") == "C", V.TWO, V.FOUR
    span = V._i(5) - V._i(0)
    zone = lambda x, common, normal, a, b: F.when(x.between(*common), a).when(x.between(*normal), b).otherwise(0)
    longer = m["three"] >= m["one"]
    prior = F.greatest(F.lit(0), F.least(F.lit(16), V._half_up((F.col("eligibility") - ALERT) * 16.0 / 25.0)))
    structure = F.when(c, 6 + prior + _award(longer, 2) + 3 + _award(V.variant() == "STANDARD", 1) + _award(span >= V.SPAN, 2)).otherwise(
        18 + _award(longer, 5) + _award(V._p(5) > V._p(3), 3) + _award(span >= V.SPAN, 2) + _award(_shortest(5) >= V.LEG, 2)
    )
    apart = F.abs(m["two"] - m["four"]) >= 0.12
    tz, fz = ((two[1], two[2]), (two[0], two[3])), ((four[1], four[2]), (four[0], four[3]))
    proportion = F.when(
        c,
        zone(m["back"], (0.382, 0.618), V.CORRECTION, 6, 4) + zone(m["c_to_a"], (V.C_TO_A[1], V.C_TO_A[2]), (V.C_TO_A[0], V.C_TO_A[3]), 6, 4)
        + zone(m["two"], *tz, 3, 2) + zone(m["four"], *fz, 3, 2) + _award(apart, 2),
    ).otherwise(
        zone(m["two"], *tz, 5, 3) + zone(m["four"], *fz, 5, 3) + F.when(apart, 4).otherwise(2)
        + _award(m["three_to_one"].between(1.0, 2.618), 3) + _award(V.ratio(m["five"], m["one"]).between(0.382, 2.618), 3)
    )
    top = (F.col("direction") == "BULLISH") != c  # the last point is a high
    fades = lambda x: F.when(top, F.col(f"t.{x}") < F.col(f"r.{x}")).otherwise(F.col(f"t.{x}") > F.col(f"r.{x}"))
    either = lambda v, k: F.when(c, k).otherwise(v)
    turns = [_award(signed(F.col(f"c.{x}"), F.col(f"b.{x}")), 2) for x in ("rsi", "macd_histogram")]
    fresh = F.when(_buys(), F.col("c.rsi") < 70).otherwise(F.col("c.rsi") > 30)
    momentum = F.when(fades("rsi"), either(6, 5)).otherwise(0) + F.when(fades("macd_histogram"), either(5, 4)).otherwise(0) + turns[0] + turns[1] + _award(c & fresh, 2)
    range_ = F.col("c.high") - F.col("c.low")
    where = F.when(range_ > 0, (F.col("c.close") - F.col("c.low")) / range_)
    confirmation = 7 + _award(signed(F.col("c.close"), F.col("c.open")), 3) + _award(F.when(_buys(), where >= 0.65).otherwise(where <= 0.35), 3) + _award(signed(F.col("c.close"), F.col("c.ema_fast")), 2)
    outer = F.when(top, F.col("t.high") >= F.col("t.band_upper")).otherwise(F.col("t.low") <= F.col("t.band_lower"))
    inside = (F.col("c.close") < F.col("c.band_upper")) & (F.col("c.close") > F.col("c.band_lower"))
    far = (F.col("t.atr") > 0) & (F.abs(F.col("t.close") - F.col("t.sma_long")) >= F.col("t.atr") * 2.0)
    levels = F.when(c, _award(signed(F.col("c.close"), F.col("c.ema_fast")), 3) + _award(signed(F.col("c.close"), F.col("c.ema_slow")), 3) + _award(outer, 2)).otherwise(_award(outer, 4) + _award(inside, 2) + _award(far, 2))
    levels = levels + _award(signed(F.col("c.close"), F.col("c.vwap")), 2)
    volume = F.when(F.col("t.volume") <= F.col("r.volume"), either(3, 2)).otherwise(0) + F.when((F.col("c.average_volume") > 0) & (F.col("c.volume") >= F.col("c.average_volume") * 1.2), either(2, 3)).otherwise(0)
    timing = _award(span >= V.SPAN, 3) + F.when(F.when(c, _shortest(8)).otherwise(_shortest(5)) >= V.LEG, 2).otherwise(0)
    most = {"structure": (structure, 30), "proportion": (proportion, 20), "momentum": (momentum, 15), "confirmation": (confirmation, 15), "levels": (levels, 10), "volume_points": (volume, 5), "timing": (timing, 5)}
    return {k: F.least(F.lit(n), F.coalesce(x, F.lit(0))).cast("int") for k, (x, n) in most.items()}


def name() -> Column:
    """Pattern of a signal."""
    ending = F.when(F.col("kind") == "IMPULSE", "IMPULSE").when(F.col("kind") == "V", F.when(V._p(5) <= V._p(3), "TRUNCATED_WAVE_V_END").otherwise("WAVE_V_END"))
    flat = F.when(V.variant() == "STANDARD", "CORRECTION").otherwise(F.concat(V.variant(), F.lit("_CORRECTION")))
    return F.concat_ws("_", F.lit("ELLIOTT"), F.col("direction"), F.coalesce(ending, flat))


def variant_of(pattern: Column) -> Column:
    """Variant of the structure that a pattern of `name` asks for."""
    flat = F.when(pattern.contains("EXPANDED_FLAT"), "EXPANDED_FLAT").when(pattern.contains("RUNNING_FLAT"), "RUNNING_FLAT").otherwise("STANDARD")
    return F.when(pattern.endswith("CORRECTION"), flat).otherwise(F.when(pattern.contains("TRUNCATED"), "TRUNCATED").otherwise("FULL"))


def signals(enriched: DataFrame) -> DataFrame:
    """All signals of every bar, the best (by eligibility) of each kind and side, with the
    scores of both models: eligibility, score and its families, strength."""
    found = V.measured(with_bars(present_counts(enriched).filter(valid()), enriched).filter(follows()))
    found = found.withColumns({"eligibility": eligibility(), "side": F.when(_buys(), "BUY").otherwise("SELL"), "pattern": name()})
    parts = families()
    found = found.withColumns({k: F.when(F.col("kind") != "IMPULSE", v).otherwise(0) for k, v in parts.items()})
    total = F.when(F.col("kind") == "IMPULSE", F.col("eligibility")).otherwise(F.least(F.lit(100), sum((F.col(k) for k in parts), F.lit(0))))
    w = Window.partitionBy("symbol", "interval", "now", "kind", "side").orderBy(F.desc("eligibility"), "sensitivity")
    best = found.withColumn("score", total).withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    strength = F.when(F.col("score") < ALERT, "LOW_CONFIDENCE").when(F.col("score") >= STRONG, "HIGH_CONFIDENCE").otherwise("MEDIUM_CONFIDENCE")
    return best.select("symbol", "interval", F.col("now").alias("idx"), F.col("c.ts").alias("ts"), "kind", "pattern", "direction", "side", "turn", "sensitivity", "eligibility", "score", *parts, strength.alias("strength"), F.col("c.close").alias("price"), "end_idx", "end_price", "third")


def alerts(signals: DataFrame) -> DataFrame:
    """Ends of wave V and of corrections whose eligibility is enough."""
    return signals.filter((F.col("eligibility") >= ALERT) & F.col("kind").isin("V", "C"))


def outcomes(alerts: DataFrame, bars: DataFrame, windows: tuple[tuple[int, float], ...]) -> DataFrame:
    """Alerts (with idx) by (bars held, deciding move): exit, signed close return, best and worst move, outcome.

    Alerts before a full WINDOW of bars, or that not all horizons follow in full, drop out, so that every
    horizon counts the same ones.
    What follows a bar comes from frames over the bars; an alert meets one bar."""
    w, fwd = B.W(), max(n for n, _ in windows)
    held = [F.struct(F.lit(n).alias("horizon"), F.lit(m).alias("move"), F.lead("ts", n).over(w).alias("exit_ts"), F.lead("close", n).over(w).alias("exit_close"), F.max("high").over(w.rowsBetween(1, n)).alias("highest"), F.min("low").over(w.rowsBetween(1, n)).alias("lowest")) for n, m in windows]
    follows = bars.select("symbol", "interval", "idx", "close", F.lead("ts", fwd).over(w).alias("_full"), F.array(*held).alias("_held")).filter((F.col("idx") >= WINDOW) & F.col("_full").isNotNull()).drop("_full")
    rows = alerts.select("symbol", "interval", "idx", "ts", "pattern", "side", "score").join(follows, ["symbol", "interval", "idx"]).withColumn("o", F.explode("_held"))
    move = lambda p: (p - F.col("close")) / F.col("close") * 100.0
    high, low, buy = move(F.col("o.highest")), move(F.col("o.lowest")), F.col("side") == "BUY"
    change = B.signed(F.col("side"), move(F.col("o.exit_close")))
    decided = F.when(change >= F.col("o.move"), "SUCCESS").when(change <= -F.col("o.move"), "FAILURE").otherwise("INCONCLUSIVE")
    return rows.select(
        "symbol", "interval", "ts", "pattern", "side", "score", F.col("close").alias("entry_price"), "o.horizon", "o.move", "o.exit_ts",
        change.alias("close_return"), F.when(buy, high).otherwise(-low).alias("best_move"), F.when(buy, low).otherwise(-high).alias("worst_move"), decided.alias("outcome"),
    )


def outcome_stats(outcomes: DataFrame) -> DataFrame:
    """Per interval, horizon, least score and stage (ALL, V, C): counts, precision of the decided and mean moves."""
    stage = F.when(F.col("pattern").endswith("CORRECTION"), "C").otherwise("V")
    least = F.filter(F.array(*[F.lit(n) for n in SCORES]), lambda n: n <= F.col("score"))
    each = outcomes.withColumn("stage", F.explode(F.array(F.lit("ALL"), stage))).withColumn("least", F.explode(least))
    n = lambda x: F.count_if(F.col("outcome") == x)
    decided = n("SUCCESS") + n("FAILURE")
    return each.groupBy("interval", "horizon", "move", "least", "stage").agg(
        F.count("*").alias("signals"), n("SUCCESS").alias("successes"), n("FAILURE").alias("failures"), n("INCONCLUSIVE").alias("inconclusive"),
        F.round(F.when(decided > 0, n("SUCCESS") * 100.0 / decided), 6).alias("precision"), *[F.round(F.avg(c), 6).alias(f"average_{c}") for c in ("close_return", "best_move", "worst_move")],
    )
