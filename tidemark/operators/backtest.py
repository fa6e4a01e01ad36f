"""Back-tests, lifecycles and their statistics over detected signals.

Signals are rows of (symbol, interval, ts, idx, pattern, direction, ...). What
happens after a signal comes from forward frames over the bars, or from joins on
the dense bar index: never from a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.indicators import W

#: Bars held and move that decides, per interval.
HORIZONS = {"1d": (10, 3.0), "1wk": (4, 4.0), "1mo": (3, 6.0)}
COST = 0.20


def signed(direction: Column, change: Column) -> Column:
    return F.when(direction == "BUY", change).otherwise(-change)


def with_future(bars: DataFrame, fwd: int) -> DataFrame:
    """exit_ts, exit_close, best_high, worst_low over the next fwd bars; null when fewer remain."""
    ahead = W().rowsBetween(1, fwd)
    full = F.lead("ts", fwd).over(W()).isNotNull()
    return bars.withColumns({
        "exit_ts": F.lead("ts", fwd).over(W()), "exit_close": F.lead("close", fwd).over(W()),
        "max_high": F.when(full, F.max("high").over(ahead)), "min_low": F.when(full, F.min("low").over(ahead)),
    })


def trades(signals: DataFrame, min_history: int, min_move: float) -> DataFrame:
    """Labelled trades of signals that carry with_future's columns: entry at the
    close, exit fwd bars later; signals without the full horizon are dropped."""
    buy, entry = F.col("direction") == "BUY", F.col("close")
    best = F.when(buy, F.col("max_high") - entry).otherwise(entry - F.col("min_low")) / entry * 100.0
    worst = F.when(buy, F.col("min_low") - entry).otherwise(entry - F.col("max_high")) / entry * 100.0
    df = signals.filter((F.col("direction") != "HOLD") & F.col("exit_ts").isNotNull() & (F.col("idx") >= min_history))
    df = df.withColumns({"entry_price": entry, "close_return": signed(F.col("direction"), (F.col("exit_close") - entry) / entry * 100.0), "best_move": best, "worst_move": worst})
    return df.withColumn("outcome", outcome(F.col("close_return"), min_move))


def outcome(change: Column, move: float) -> Column:
    return F.when(change >= move, "SUCCESS").when(change <= -move, "FAILURE").otherwise("INCONCLUSIVE")


def measures() -> list[Column]:
    """Counts, success rate, precision (without the inconclusive) and average return."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    decided = n("SUCCESS") + n("FAILURE")
    return [
        F.count("*").alias("signals"), F.count_if(F.col("direction") == "BUY").alias("buys"), F.count_if(F.col("direction") == "SELL").alias("sells"),
        n("SUCCESS").alias("successes"), n("FAILURE").alias("failures"), n("INCONCLUSIVE").alias("inconclusive"),
        F.round(n("SUCCESS") * 100.0 / F.count("*"), 6).alias("success_rate"),
        F.round(F.when(decided > 0, n("SUCCESS") * 100.0 / decided), 6).alias("precision"), F.round(F.avg("close_return"), 6).alias("average_return"),
    ]


def report(trades: DataFrame, *by: str) -> DataFrame:
    return trades.groupBy(*by).agg(*measures())


def score_bucket(score: Column) -> Column:
    return F.when(score < 50, "0-49").when(score < 60, "50-59").when(score < 70, "60-69").when(score < 80, "70-79").otherwise("80-100")


def threshold_sweep(trades: DataFrame, filters: DataFrame) -> DataFrame:
    """Measures of every score filter (filter, least, most; a short fixed list)."""
    return trades.join(F.broadcast(filters), F.col("setup_score").between(F.col("least"), F.col("most"))).groupBy("filter", "least", "most").agg(*measures())


def wilson(s: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the 95 % Wilson interval of s successes in n, in per cent."""
    p, z2 = s / n, z * z
    centre, half = p + z2 / (2.0 * n), z * F.sqrt(p * (1.0 - p) / n + z2 / (4.0 * n * n))
    low, high = (centre - half) / (1.0 + z2 / n), (centre + half) / (1.0 + z2 / n)
    return F.when(n > 0, low * 100.0), F.when(n > 0, high * 100.0)


def shrunk_precision(trades: DataFrame, prior: int = 30) -> DataFrame:
    """Precision of each pattern drawn towards its side's, and the lift over it."""
    s, f = F.count_if(F.col("outcome") == "SUCCESS"), F.count_if(F.col("outcome") == "FAILURE")
    own = trades.groupBy("pattern", "direction").agg(s.alias("s"), (s + f).alias("n"))
    side = trades.groupBy("direction").agg((s / F.nullif(s + f, F.lit(0))).alias("p_side"))
    df = own.join(side, "direction")
    shrunk = (F.col("s") + prior * F.col("p_side")) / (F.col("n") + prior)
    return df.select("pattern", "direction", "s", "n", F.round(shrunk * 100, 6).alias("shrunk"), F.round((shrunk - F.col("p_side")) * 100, 6).alias("lift"))


# ---------------------------------------------------------------- lifecycle


def lifecycle_init(signals: DataFrame) -> DataFrame:
    """Formation high and low of the pattern's bars, trigger and invalidation by side.

    Needs c0..c2 (the bar and the two before)."""
    parts = F.slice(F.array("c0", "c1", "c2"), F.lit(1), F.col("size"))
    high, low = F.array_max(F.transform(parts, lambda x: x["high"])), F.array_min(F.transform(parts, lambda x: x["low"]))
    buy = F.col("direction") == "BUY"
    return signals.filter("direction <> 'HOLD'").withColumns({"formation_high": high, "formation_low": low}).withColumns({
        "trigger": F.when(buy, F.col("formation_high")).otherwise(F.col("formation_low")), "invalidation": F.when(buy, F.col("formation_low")).otherwise(F.col("formation_high")),
    })


def forward_bars(signals: DataFrame, bars: DataFrame, k: int) -> DataFrame:
    """Each signal with its next k bars: offset (from 1) and the bar's f_ columns."""
    ahead = signals.withColumn("offset", F.explode(F.sequence(F.lit(1), F.lit(k))))
    b = bars.select("symbol", "interval", F.col("idx").alias("f_idx"), *[F.col(c).alias(f"f_{c}") for c in ("ts", "open", "high", "low", "close")])
    return ahead.join(b.withColumnsRenamed({"symbol": "f_symbol", "interval": "f_interval"}), (F.col("symbol") == F.col("f_symbol")) & (F.col("interval") == F.col("f_interval")) & (F.col("idx") + F.col("offset") == F.col("f_idx"))).drop("f_symbol", "f_interval", "f_idx")


def lifecycle_resolve(initial: DataFrame, bars: DataFrame, window: int = 3) -> DataFrame:
    """status and resolution_offset: the first close beyond the trigger confirms,
    beyond the other side invalidates (equality does neither); after `window`
    closes a signal expires; with fewer it stays DETECTED."""
    keys = ["symbol", "interval", "ts", "pattern", "direction", "trigger", "invalidation"]
    f = forward_bars(initial.select(*keys, "idx"), bars, window)
    buy, c = F.col("direction") == "BUY", F.col("f_close")
    hit = F.when(F.when(buy, c > F.col("trigger")).otherwise(c < F.col("trigger")), "CONFIRMED").when(F.when(buy, c < F.col("invalidation")).otherwise(c > F.col("invalidation")), "INVALIDATED")
    found = f.withColumn("hit", hit).groupBy(*keys).agg(F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("offset"))).alias("hit"), F.min(F.when(F.col("hit").isNotNull(), F.col("offset"))).alias("at"), F.count("*").alias("seen"))
    df = initial.select(*keys).join(found, keys, "left")
    status = F.when(F.col("hit").isNotNull(), F.col("hit")).when(F.col("seen") >= window, "EXPIRED").otherwise("DETECTED")
    return df.select(*keys, status.alias("status"), F.coalesce("at", F.when(F.col("seen") >= window, F.lit(window))).alias("resolution_offset"))


def scan_context(bars: DataFrame, lookback: int, window: int = 3) -> DataFrame:
    """Adds _left (bars from this one to the newest, counted up to lookback + 1) and _ahead (ts and close of the next `window` bars)."""
    return bars.withColumns({"_left": F.count("*").over(W().rowsBetween(0, lookback)), "_ahead": F.collect_list(F.struct("ts", "close")).over(W().rowsBetween(1, window))})


def historical_scan(signals: DataFrame, lookback: int, fwd: int, move: float, window: int = 3) -> DataFrame:
    """Signals of each symbol's newest `lookback` bars with formation, lifecycle and outcome, in the
    order of the scan (place: newest first, then pattern).

    Needs the columns of with_future and scan_context on the signals' bars. While fewer than `fwd` bars
    follow, the outcome is PENDING, `remaining` says how many are missing and what is measured is
    null. The lifecycle is resolved by the bars at hand, as in lifecycle_resolve, without a join."""
    s = lifecycle_init(signals.filter(F.col("_left") <= lookback))
    buy, pending, entry = F.col("direction") == "BUY", F.col("exit_ts").isNull(), F.col("close")

    def hit(c: Column) -> Column:
        return F.when(F.when(buy, c > F.col("trigger")).otherwise(c < F.col("trigger")), "CONFIRMED").when(F.when(buy, c < F.col("invalidation")).otherwise(c > F.col("invalidation")), "INVALIDATED")

    hits = F.transform("_ahead", lambda x: F.coalesce(hit(x["close"]), F.lit("")))
    at = F.coalesce(*[F.when(F.get("_hits", F.lit(k)) != "", k + 1) for k in range(window)], F.when(F.size("_hits") >= window, window))
    s = s.withColumn("_hits", hits).withColumn("resolution_offset", at.cast("int")).withColumn("_at", F.get("_ahead", F.col("resolution_offset") - 1))
    found = F.get("_hits", F.col("resolution_offset") - 1)
    change, up, down = signed(F.col("direction"), (F.col("exit_close") - entry) / entry * 100.0), (F.col("max_high") - entry) / entry * 100.0, (F.col("min_low") - entry) / entry * 100.0
    w = Window.partitionBy("symbol", "interval").orderBy(F.desc("ts"), "pattern")
    return s.select(
        "symbol", "interval", F.row_number().over(w).alias("place"), "ts", "pattern", "direction", "close", F.col("size").alias("formation_bars"), "formation_high", "formation_low", "trigger", "invalidation",
        F.when(pending, "PENDING").otherwise(outcome(change, move)).alias("outcome"), F.when(pending, F.lit(fwd + 1) - F.col("_left")).cast("int").alias("remaining"),
        F.col("exit_ts").alias("evaluation_ts"), F.col("exit_close").alias("evaluation_close"), change.alias("directional_return"), F.when(buy, up).otherwise(-down).alias("best_move"), F.when(buy, down).otherwise(-up).alias("worst_move"),
        F.when(F.col("resolution_offset").isNull(), "DETECTED").when(found == "", "EXPIRED").otherwise(found).alias("status"), "resolution_offset", F.col("_at.ts").alias("resolution_ts"), F.col("_at.close").alias("resolution_close"),
    )


def resampled(bars: DataFrame, to: str, label: str = "first") -> DataFrame:
    """Daily bars to weeks or months; ts is the first or the last daily ts."""
    unit = {"1wk": "week", "1mo": "month"}[to]
    at = F.min("ts") if label == "first" else F.max("ts")
    g = bars.groupBy("symbol", F.date_trunc(unit, "ts").alias("_p")).agg(at.alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return g.select("symbol", F.lit(to).alias("interval"), "ts", "open", "high", "low", "close", "volume")
