"""Swing pivots, wave counts and their lifecycles.

Pivots come from a fold in chunks (see pivots).
Everything after works on pivots as rows: counts are windows of consecutive
pivots, rules are filters, confirmations are joins on the bar index.
Bearish counts are bullish ones with prices turned around, so each rule is said once.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.pivots import pivots

# Swing sensitivities; zones of retracements and ratios.
SENSITIVITIES = (0.75, 1.25, 2.0, 3.0)
LEG, SPAN, LAG, QUALITY = 2, 15, 3, 68
TWO, FOUR = (0.236, 0.382, 0.618, 0.786), (0.146, 0.236, 0.5, 0.618)
CORRECTION, C_TO_A = (0.236, 0.786), (0.5, 0.8, 1.25, 2.0)


def swings(high: np.ndarray, low: np.ndarray, close: np.ndarray, reach: np.ndarray) -> list[tuple[int, int]]:
    """(bar, sign) of alternating extremes: sign 1 for highs; a turn needs reach[bar of the extreme]."""
    out: list[tuple[int, int]] = []
    edge = {1: high, -1: low}
    mid = (high + low) / 2
    side, top, bottom = 0, 0, 0
    for i in range(1, len(high)):
        if not side:
            top, bottom = (i if high[i] >= high[top] else top), (i if low[i] <= low[bottom] else bottom)
            if high[top] - low[bottom] >= max(reach[top], reach[bottom]):
                side = 1 if bottom < top or (bottom == top and close[i] >= mid[i]) else -1
                out.append((bottom, -1) if side == 1 else (top, 1))
                best = top if side == 1 else bottom
            continue
        ahead, back = edge[side], edge[-side]
        if (ahead[i] - ahead[best]) * side >= 0:
            best = i
        if (ahead[best] - back[i]) * side >= reach[best] and (best < i or (close[i] - mid[i]) * side <= 0):
            at, sign = out[-1]
            if sign == side:
                # the turn between was dropped: the more extreme of two like ones stays
                if (ahead[best] - ahead[at]) * side > 0:
                    out[-1] = (best, side)
            elif at != best:
                out.append((best, side))
            side, best = -side, i
    return out


def volatility(high: np.ndarray, low: np.ndarray, close: np.ndarray, atr: np.ndarray) -> np.ndarray:
    """The average true range, or where it is missing the mean of the last 14 bars' ranges."""
    lacks = ~(atr > 0)
    if not lacks.any():
        return atr
    before = np.concatenate([[close[0]], close[:-1]])
    true = np.maximum(np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before))), 1e-6)
    used, out = np.where(lacks, true, atr), atr.copy()
    for i in np.flatnonzero(lacks):
        out[i] = used[max(0, i - 13) : i + 1].mean()
    return out


def zigzag_pivots(enriched: DataFrame, sensitivities: tuple[float, ...] = SENSITIVITIES) -> DataFrame:
    """One row per pivot and sensitivity; sensitivities with the same pivots count once (the smallest). A written table."""
    return pivots(enriched, sensitivities)


def sequences(pivots: DataFrame, n: int) -> DataFrame:
    """Every run of n consecutive pivots: array p of (idx, ts, price), and direction by its first kind."""
    w = Window.partitionBy("symbol", "interval", "sensitivity").orderBy("seq")
    df = pivots.withColumn("p", F.collect_list(F.struct("idx", "ts", "price")).over(w.rowsBetween(0, n - 1)))
    return pointed(df.filter(F.size("p") == n).select("symbol", "interval", "sensitivity", "seq", F.when(F.col("kind") == "LOW", "BULLISH").otherwise("BEARISH").alias("direction"), "p"))


def _p(i: int) -> Column:
    """Price of point i, turned around for bearish counts."""
    return F.col(f"q{i}")


def _i(i: int) -> Column:
    return F.col(f"i{i}")


def pointed(counts: DataFrame) -> DataFrame:
    """Adds the points of p as columns: q0.. turned prices, i0.. bar numbers; null beyond the last."""
    sign = F.when(F.col("direction") == "BULLISH", 1.0).otherwise(-1.0)
    at = lambda k: F.get("p", F.lit(k))
    return counts.withColumns({f"q{k}": at(k)["price"] * sign for k in range(9)} | {f"i{k}": at(k)["idx"] for k in range(9)})


def ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) >= 0.000001, a / b)


def impulse_base() -> Column:
    one, three = _p(1) - _p(0), _p(3) - _p(2)
    two, four = ratio(_p(1) - _p(2), one), ratio(_p(3) - _p(4), three)
    legs = F.lit(True)
    for k in range(4):
        legs = legs & (_i(k + 1) - _i(k) >= LEG)
    return (_p(1) > _p(0)) & (_p(2) > _p(0)) & (_p(3) > _p(1)) & (_p(4) > _p(2)) & (_p(4) > _p(1)) & (two > 0) & (two < 1) & (four > 0) & (four < 1) & legs


def impulse_complete() -> Column:
    return impulse_base() & (_p(5) > _p(4)) & (_p(3) - _p(2) >= F.least(_p(1) - _p(0), _p(5) - _p(4))) & (_i(5) - _i(4) >= LEG)


def correction_complete() -> Column:
    recovery, back = ratio(_p(7) - _p(6), _p(5) - _p(6)), ratio(_p(5) - _p(8), _p(5) - _p(0))
    legs = (_i(6) - _i(5) >= LEG) & (_i(7) - _i(6) >= LEG) & (_i(8) - _i(7) >= LEG)
    return impulse_complete() & (_p(6) < _p(5)) & (_p(6) > _p(0)) & (_p(7) > _p(6)) & (_p(8) < _p(7)) & (recovery <= 2) & (back > 0) & (back < 1) & legs


def variant() -> Column:
    return F.when(_p(7) <= _p(5), "STANDARD").when(_p(8) < _p(6), "EXPANDED_FLAT").otherwise("RUNNING_FLAT")


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def _unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0)))


def _over(a: Column, b: Column, most: int) -> Column:
    """Rounded share of `most` points."""
    return _half_up(_unit(a / b) * most)


# Points taken for what is unusual.


def two_penalty(two: Column) -> Column:
    return F.when((two > TWO[3]) & (two < 1), 8 + _over(two - TWO[3], F.lit(1 - TWO[3]), 12)).when(two < TWO[0], 6).otherwise(0)


def three_penalty(r: Column) -> Column:
    return F.when(r >= 0.8, 0).otherwise(6 + _over(0.8 - F.greatest(F.lit(0.0), r), F.lit(0.8), 8))


def four_penalty(four: Column) -> Column:
    return F.when(four < FOUR[0], 6 + _over(FOUR[0] - four, F.lit(FOUR[0]), 4)).when(four > FOUR[3], 8 + _over(four - FOUR[3], F.lit(1 - FOUR[3]), 8)).otherwise(0)


def span_penalty(span: Column) -> Column:
    return F.when(span >= SPAN, 0).otherwise(F.least(F.lit(10), F.greatest(F.lit(1), (SPAN - span) * 2)))


def back_penalty(back: Column) -> Column:
    lo, hi = CORRECTION
    return F.when(back < lo, 6 + _over(lo - back, F.lit(lo), 4)).when(back > hi, 8 + _over(back - hi, F.lit(1 - hi), 10)).otherwise(0)


def c_to_a_penalty(ca: Column) -> Column:
    lo, hi = C_TO_A[0], C_TO_A[3]
    return F.when(ca < lo, 6 + _over(lo - ca, F.lit(lo), 4)).when(ca > hi, 8 + F.least(F.lit(8), _half_up((ca - hi) * 4))).otherwise(0)


def variant_penalty(kind: Column) -> Column:
    return F.when(kind == "EXPANDED_FLAT", 4).when(kind == "RUNNING_FLAT", 14).otherwise(0)


TRUNCATION = 18


def measured(counts: DataFrame) -> DataFrame:
    """Adds lengths and ratios of a count's waves, as m_ columns (those of a correction
    are null for fewer than nine points)."""
    one, three = _p(1) - _p(0), _p(3) - _p(2)
    all_ = {
        "one": one, "three": three, "five": _p(5) - _p(4), "two": ratio(_p(1) - _p(2), one), "four": ratio(_p(3) - _p(4), three), "three_to_one": ratio(three, one),
        "back": ratio(_p(5) - _p(8), _p(5) - _p(0)), "c_to_a": ratio(_p(7) - _p(8), _p(5) - _p(6)),
    }
    return counts.withColumns({f"m_{k}": c for k, c in all_.items()})


MEASURES = ("one", "three", "five", "two", "four", "three_to_one", "back", "c_to_a")


def measures() -> dict[str, Column]:
    return {k: F.col(f"m_{k}") for k in MEASURES}


def quality(correction: bool) -> Column:
    """0 to 100: move, span, third wave, retracement zones, alternation and origin, less penalties.

    Needs `atr_mean` (over the count) and `origin` (how far price stood beyond the origin before it)."""
    m = measures()
    one, three, five, two, four = (m[k] for k in ("one", "three", "five", "two", "four"))
    atr, span = F.greatest(F.col("atr_mean"), F.lit(0.000001)), _i(5) - _i(0)
    s = F.lit(55) + _half_up(F.least(F.lit(12.0), (_p(5) - _p(0)) / atr))
    s = s + F.when(span >= SPAN, F.least(F.lit(8), F.floor((span - SPAN) / 5))).otherwise(-span_penalty(span))
    s = s + F.when((three >= one) & (three >= five), 7).otherwise(0) - three_penalty(m["three_to_one"])
    s = s + F.when(two.between(TWO[1], TWO[2]), 5).otherwise(0) - two_penalty(two)
    s = s + F.when(four.between(FOUR[1], FOUR[2]), 5).otherwise(0) - four_penalty(four)
    s = s - F.when(_p(5) <= _p(3), TRUNCATION).otherwise(0) + F.when(F.abs(two - four) >= 0.08, 3).otherwise(0)
    off = F.col("origin") / atr
    s = s + F.when(off <= 0.75, 8).when(off <= 1.5, 3).otherwise(-F.least(F.lit(18), _half_up(off * 3.0)))
    if correction:
        back, ca = m["back"], m["c_to_a"]
        s = s + 4 + F.when(back.between(*CORRECTION), 4).otherwise(-back_penalty(back))
        s = s + F.when(ca.between(C_TO_A[1], C_TO_A[2]), 5).otherwise(-c_to_a_penalty(ca)) - variant_penalty(variant())
    return F.greatest(F.lit(0), F.least(F.lit(100), s)).cast("int")


def _percent(c: Column) -> Column:
    return F.concat((_half_up(c * 1000) / 10).cast("string"), F.lit("%"))


def warnings() -> Column:
    """What lowers a structure's quality, in words (for pointed and measured structures)."""
    m, span, c = measures(), _i(5) - _i(0), F.col("stage") == "C"
    less = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit(" — reduced confidence"))
    flags = [
        F.when(two_penalty(m["two"]) > 0, less(F.when(m["two"] > TWO[3], "Deep").otherwise("Shallow"), " Wave II ", _percent(m["two"]))),
        F.when(m["three_to_one"] < 0.8, less("Wave III is ", _percent(m["three_to_one"]), " of Wave I")),
        F.when(four_penalty(m["four"]) > 0, less(F.when(m["four"] > FOUR[3], "Deep").otherwise("Shallow"), " Wave IV ", _percent(m["four"]))),
        F.when(span < SPAN, less("Compressed ", span.cast("string"), "-candle impulse")),
        F.when(_p(5) <= _p(3), less("Truncated Wave V")),
        F.when(c & (back_penalty(m["back"]) > 0), less("A–B–C retracement ", _percent(m["back"]))),
        F.when(c & (c_to_a_penalty(m["c_to_a"]) > 0), less("Wave C is ", (_half_up(m["c_to_a"] * 100) / 100).cast("string"), "× Wave A")),
        F.when(F.col("variant") == "EXPANDED_FLAT", less("Expanded-flat candidate")).when(F.col("variant") == "RUNNING_FLAT", less("Running-flat candidate")),
    ]
    return F.array_compact(F.array(*flags))


def with_context(counts: DataFrame, enriched: DataFrame) -> DataFrame:
    """atr_mean over each count, from running sums at its two ends, and origin: how far
    price stood beyond the first point on the bars before it (at least eight, or half
    the impulse), joined by bar number. No history is gathered."""
    keys = ["symbol", "interval", "sensitivity", "seq"]
    w = Window.partitionBy("symbol", "interval").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    true = F.greatest(F.col("high") - F.col("low"), F.lit(0.000001))
    bars = enriched.select("symbol", "interval", "idx", "low", "high", F.sum(F.coalesce(F.when(F.col("atr") > 0, F.col("atr")), true)).over(w).alias("upto"))
    first, last = _i(0), F.element_at("p", -1)["idx"]
    sums = lambda name, shift: bars.select("symbol", "interval", (F.col("idx") + shift).alias(f"{name}_idx"), F.col("upto").alias(name))
    df = counts.withColumns({"until_idx": last, "before_idx": first})
    df = df.join(sums("until", 0), ["symbol", "interval", "until_idx"]).join(sums("before", 1), ["symbol", "interval", "before_idx"], "left")
    df = df.withColumn("atr_mean", (F.col("until") - F.coalesce("before", F.lit(0.0))) / (last - first + 1)).drop("until", "until_idx", "before", "before_idx")
    look = F.greatest(F.lit(8), F.floor((_i(5) - first) / 2))
    near = counts.select(*keys, F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), first - look), first)).alias("idx"))
    near = near.join(bars.select("symbol", "interval", "idx", "low", "high"), ["symbol", "interval", "idx"]).groupBy(*keys).agg(F.min("low").alias("lowest"), F.max("high").alias("highest"))
    price = F.get("p", F.lit(0))["price"]
    beyond = F.when(F.col("direction") == "BULLISH", price - F.col("lowest")).otherwise(F.col("highest") - price)
    return df.join(near, keys).withColumn("origin", F.greatest(F.lit(0.0), beyond)).drop("lowest", "highest")


def structures(pivots: DataFrame, enriched: DataFrame) -> DataFrame:
    """Valid impulses (to V) and corrections (to C) with quality, variant, cycle key and end."""
    out = None
    for n, rule, label in ((6, impulse_complete(), "V"), (9, correction_complete(), "C")):
        df = measured(with_context(sequences(pivots, n).filter(rule), enriched))
        end = F.element_at("p", -1)
        key = F.concat_ws(":", F.col("direction"), *[F.unix_timestamp(F.get("p", F.lit(k))["ts"]).cast("string") for k in range(5)])
        df = df.select("symbol", "interval", "sensitivity", "direction", F.lit(label).alias("stage"), quality(label == "C").alias("quality"), (variant() if label == "C" else F.when(_p(5) <= _p(3), "TRUNCATED").otherwise("FULL")).alias("variant"), key.alias("cycle_key"), _i(0).alias("start_idx"), end["idx"].alias("end_idx"), end["ts"].alias("end_ts"), end["price"].alias("end_price"), "p")
        out = df if out is None else out.unionByName(df)
    return out


def latest_structure(structures: DataFrame) -> DataFrame:
    good = structures.filter(F.col("quality") >= QUALITY)
    return good.groupBy("symbol", "interval").agg(F.max_by(F.struct("direction", "stage", "quality", "cycle_key", "end_ts"), F.struct("end_idx", "quality", (F.col("end_idx") - F.col("start_idx")).alias("span"), "cycle_key")).alias("s")).select("symbol", "interval", "s.*")


def historical_structures(structures: DataFrame, overlap: float = 0.40) -> DataFrame:
    """Best per direction, stage and end, then greedily by quality those that
    overlap no chosen one by more than 40 % of the shorter.

    Spans that touch no other, not even through a chain of overlaps, can't exclude each
    other: a group is one such island, not a symbol.
    """
    w = Window.partitionBy("symbol", "interval", "direction", "stage", "end_ts").orderBy(F.desc("quality"), "start_idx", "sensitivity")
    best = structures.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("symbol", "interval", "direction", "stage", "quality", "start_idx", "end_idx", "end_ts", "cycle_key")
    along = Window.partitionBy("symbol", "interval").orderBy("start_idx", "end_idx", "direction", "stage")
    reached = F.max("end_idx").over(along.rowsBetween(Window.unboundedPreceding, -1))
    dealt = best.withColumn("fresh", F.coalesce(F.col("start_idx") >= reached, F.lit(True)).cast("int"))
    dealt = dealt.withColumn("island", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(span=rows["end_idx"] - rows["start_idx"]).sort_values(["quality", "stage", "span", "end_idx", "direction"], ascending=[False, True, False, True, True])
        kept = Spans(overlap)
        return rows[[kept.add(a, b) for a, b in zip(rows["start_idx"].tolist(), rows["end_idx"].tolist(), strict=True)]].drop(columns=["span", "island"])

    return dealt.groupBy("symbol", "interval", "island").applyInPandas(choose, best.schema)


class Spans:
    """Chosen spans in order of their starts; a new one is compared with those near it only."""

    def __init__(self, overlap: float):
        self.overlap, self.spans, self.longest = overlap, [], 0

    def add(self, a: int, b: int) -> bool:
        """Adds the span unless it overlaps a chosen one by more than the given part of the shorter."""
        for k in range(bisect_left(self.spans, (a - self.longest, a)), bisect_left(self.spans, (b, b))):
            x, y = self.spans[k]
            if min(b, y) - max(a, x) > self.overlap * min(b - a, y - x):
                return False
        insort(self.spans, (a, b))
        self.longest = max(self.longest, b - a)
        return True


def boundaries(structures: DataFrame) -> DataFrame:
    """Trigger (IV or B), invalidation (for C the origin; for V, where III would be
    shortest) and the side to take at the end of a count."""
    sign = F.when(F.col("direction") == "BULLISH", 1.0).otherwise(-1.0)
    at = lambda k: F.get("p", F.lit(k))["price"]
    one, three = (at(1) - at(0)) * sign, (at(3) - at(2)) * sign
    edge = F.when(F.col("stage") == "C", at(0)).when(one > three, at(4) + sign * three)
    side = F.when((F.col("stage") == "C") == (F.col("direction") == "BULLISH"), "BUY").otherwise("SELL")
    prices = F.transform("p", lambda x: x["price"])
    return structures.withColumns({"trigger": F.get("p", F.size("p") - 2)["price"], "invalidation": edge, "side": side, "high": F.array_max(prices), "low": F.array_min(prices)})


def lifecycle(bounded: DataFrame, bars: DataFrame, window: int = 10) -> DataFrame:
    """status: a structural break (by highs and lows) wins ties with a close beyond the trigger."""
    keys = ["symbol", "interval", "direction", "stage", "cycle_key", "end_idx", "side", "trigger", "invalidation"]
    s = bounded.select(*keys).distinct().withColumn("offset", F.explode(F.sequence(F.lit(1), F.lit(window))))
    b = bars.select("symbol", "interval", F.col("idx").alias("b_idx"), F.col("high").alias("b_high"), F.col("low").alias("b_low"), F.col("close").alias("b_close"))
    f = s.withColumn("b_idx", F.col("end_idx") + F.col("offset")).join(b, ["symbol", "interval", "b_idx"])
    up = F.col("direction") == "BULLISH"
    v, x = F.col("stage") == "V", F.col("invalidation")
    broken = F.when(v, F.when(up, F.col("b_high") > x).otherwise(F.col("b_low") < x)).otherwise(F.when(up, F.col("b_low") <= x).otherwise(F.col("b_high") >= x))
    confirmed = F.when(F.col("side") == "BUY", F.col("b_close") > F.col("trigger")).otherwise(F.col("b_close") < F.col("trigger"))
    g = f.groupBy(*keys).agg(F.min(F.when(broken, F.col("offset"))).alias("broken_at"), F.min(F.when(confirmed, F.col("offset"))).alias("confirmed_at"), F.count("*").alias("seen"))
    status = F.when(F.col("broken_at") <= F.coalesce("confirmed_at", F.lit(window)), "INVALIDATED").when(F.col("confirmed_at").isNotNull(), "CONFIRMED").when(F.col("seen") >= window, "EXPIRED").otherwise("DETECTED")
    return g.withColumn("status", status)


def confirmation(structures: DataFrame, bars: DataFrame) -> DataFrame:
    """First bar within LAG bars of the end that closes beyond the bar before it."""
    s = structures.select("symbol", "interval", "direction", "stage", "cycle_key", "end_idx").distinct().withColumn("offset", F.explode(F.sequence(F.lit(1), F.lit(LAG))))
    w = Window.partitionBy("symbol", "interval").orderBy("ts")
    b = bars.select("symbol", "interval", F.col("idx").alias("b_idx"), "close", F.lag("high").over(w).alias("ph"), F.lag("low").over(w).alias("pl"))
    f = s.withColumn("b_idx", F.col("end_idx") + F.col("offset")).join(b, ["symbol", "interval", "b_idx"])
    rises = (F.col("stage") == "C") == (F.col("direction") == "BULLISH")
    hit = F.when(rises, F.col("close") > F.col("ph")).otherwise(F.col("close") < F.col("pl"))
    return f.filter(hit).groupBy("symbol", "interval", "direction", "stage", "cycle_key", "end_idx").agg(F.min("offset").alias("lag"))


def confirmed(structures: DataFrame, bars: DataFrame) -> DataFrame:
    """Structures with confirm_idx and confirm_ts of their timely confirmation (others drop out)."""
    keys = ["symbol", "interval", "direction", "stage", "cycle_key", "end_idx"]
    found = structures.join(confirmation(structures, bars), keys).withColumn("confirm_idx", F.col("end_idx") + F.col("lag")).drop("lag")
    return found.join(bars.select("symbol", "interval", F.col("idx").alias("confirm_idx"), F.col("ts").alias("confirm_ts")), ["symbol", "interval", "confirm_idx"])


def structure_for_signal(structures: DataFrame, signals: DataFrame) -> DataFrame:
    """signals (symbol, interval, direction, stage, variant, ts) with the structure of
    their kind that was confirmed last, up to the signal (then by quality and span).

    An as-of join by one window over both, so no pair of a signal and an older
    structure is formed."""
    kind = ["symbol", "interval", "direction", "stage", "variant"]
    span = (F.col("end_idx") - F.col("start_idx")).alias("span")
    held = F.struct("cycle_key", "quality", "end_ts", "confirm_ts").alias("found")
    s = structures.select(*kind, F.col("confirm_ts").alias("ts"), F.lit(0).alias("asks"), "quality", span, held)
    none = F.lit(None).cast(s.schema["found"].dataType)
    q = signals.select(*kind, "ts", F.lit(1).alias("asks"), F.lit(None).cast("int").alias("quality"), F.lit(None).cast("long").alias("span"), none.alias("found"))
    w = Window.partitionBy(*kind).orderBy("ts", "asks", "quality", "span", F.col("found.cycle_key")).rowsBetween(Window.unboundedPreceding, 0)
    return s.unionByName(q).withColumn("found", F.last("found", ignorenulls=True).over(w)).filter("asks = 1").select(*kind, "ts", "found.*")


def structure_for_cycle(structures: DataFrame, cycles: DataFrame) -> DataFrame:
    """For each (symbol, interval, cycle_key, stage): its structure with the latest end,
    then the latest confirmation, then the best quality."""
    good = structures.filter(F.col("quality") >= QUALITY)
    best = good.groupBy("symbol", "interval", "cycle_key", "stage").agg(
        F.max(F.struct("end_ts", "confirm_ts", "quality", "end_price")).alias("s")
    )
    return cycles.join(best, ["symbol", "interval", "cycle_key", "stage"]).select("symbol", "interval", "cycle_key", "stage", "s.*")


def revised(bounded: DataFrame) -> DataFrame:
    """Per cycle and stage the boundaries first recorded and those in force: a later
    endpoint of the same cycle and stage replaces them, an earlier or equal one never."""
    by = ["symbol", "interval", "cycle_key", "stage"]
    what = F.struct("end_idx", F.col("quality"), "end_ts", "end_price", "trigger", "invalidation", "high", "low")
    g = bounded.groupBy(*by).agg(F.min(what).alias("first"), F.max(what).alias("latest"), F.count_distinct("end_idx").alias("endpoints"))
    later = F.col("latest.end_idx") > F.col("first.end_idx")
    now = lambda c: F.when(later, F.col(f"latest.{c}")).otherwise(F.col(f"first.{c}")).alias(c)
    return g.select(*by, "endpoints", later.alias("revised"), F.col("first.end_ts").alias("anchor_ts"), *[now(c) for c in ("end_ts", "end_price", "trigger", "invalidation", "high", "low")])


# Bars held and move that decides, by horizon; least qualities.
STAGE_HORIZONS = ((4, 4.0), (8, 8.0))
STAGE_QUALITIES = (75, 80, 85, 90)


def stage_stats(confirmed: DataFrame, bars: DataFrame) -> DataFrame:
    """Per horizon, least quality and stage (V, C and ALL): counts, precision and average
    return of confirmed ends, entered at the confirmation's close and left the horizon later."""
    c = confirmed.select("symbol", "interval", "direction", "stage", "cycle_key", "quality", F.col("confirm_idx").alias("idx")).distinct()
    close = bars.select("symbol", "interval", "idx", "close")
    c = c.join(close.withColumnRenamed("close", "entry"), ["symbol", "interval", "idx"])
    c = c.withColumn("h", F.explode(F.array(*[F.struct(F.lit(n).alias("bars"), F.lit(m).alias("move")) for n, m in STAGE_HORIZONS])))
    c = c.withColumn("idx", F.col("idx") + F.col("h.bars")).join(close.withColumnRenamed("close", "left"), ["symbol", "interval", "idx"])
    rises = (F.col("stage") == "C") == (F.col("direction") == "BULLISH")
    change = (F.col("left") - F.col("entry")) / F.col("entry") * 100.0
    c = c.withColumn("change", F.when(rises, change).otherwise(-change))
    c = c.withColumn("least", F.explode(F.array(*[F.lit(q) for q in STAGE_QUALITIES]))).filter("quality >= least")
    c = c.withColumn("stage", F.explode(F.array(F.col("stage"), F.lit("ALL"))))
    won, lost = F.count_if(F.col("change") >= F.col("h.move")), F.count_if(F.col("change") <= -F.col("h.move"))
    return c.groupBy("interval", F.col("h.bars").alias("bars"), "least", "stage").agg(
        F.count("*").alias("signals"), won.alias("successes"), lost.alias("failures"),
        F.round(F.when(won + lost > 0, won * 100.0 / (won + lost)), 6).alias("precision"), F.round(F.avg("change"), 6).alias("average_return"),
    )
