"""What alerts carry beside their signal: a calibrated prior, a research window, the
outcome observed since and the best and worst move on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators.indicators import W

KEYS = ["symbol", "interval", "ts", "pattern", "direction"]

# Signals, decided outcomes and shrunk precision (per cent) of each
# pattern in the frozen development sample.
CALIBRATION = {
    "1wk": {
        "MORNING_STAR": (19, 10, 77.4), "PIERCING_LINE": (28, 12, 76.1), "BULLISH_HARAMI": (52, 20, 75.9), "HAMMER": (73, 28, 70.6),
        "INVERTED_HAMMER": (70, 31, 63.9), "BULLISH_ENGULFING": (94, 44, 62.1), "BEARISH_ENGULFING": (175, 80, 27.5), "DARK_CLOUD_COVER": (59, 22, 27.4),
        "HANGING_MAN": (151, 59, 23.9), "BEARISH_HARAMI": (122, 44, 23.3), "SHOOTING_STAR": (97, 40, 21.8), "EVENING_STAR": (48, 22, 17.8),
    },
    "1mo": {
        "INVERTED_HAMMER": (38, 24, 67.8), "BULLISH_HARAMI": (35, 19, 64.5), "HAMMER": (42, 18, 63.8), "BULLISH_ENGULFING": (74, 36, 60.0),
        "MORNING_STAR": (19, 12, 56.2), "HANGING_MAN": (117, 65, 32.6), "BEARISH_HARAMI": (67, 32, 30.6), "DARK_CLOUD_COVER": (31, 15, 26.7),
        "BEARISH_ENGULFING": (150, 74, 24.0), "SHOOTING_STAR": (107, 67, 23.7), "EVENING_STAR": (31, 17, 21.3),
    },
}
# Points for a shrunk precision of at least so many per cent, the
# points without enough outcomes, and how many are enough.
POINTS = [(70.0, 10), (65.0, 9), (60.0, 8), (55.0, 7), (45.0, 5), (35.0, 3), (30.0, 2), (25.0, 1)]
NEUTRAL, ENOUGH = 5, 10
# Research window of each interval.
HORIZON_LABELS = {"1d": "10 trading sessions", "1wk": "4, 8, and 12 weeks", "1mo": "3, 6, and 9 months"}


def profiles(spark: SparkSession) -> DataFrame:
    """interval, pattern, sample, decided, precision: CALIBRATION as a table."""
    rows = [(interval, pattern, *v) for interval, held in CALIBRATION.items() for pattern, v in held.items()]
    return spark.createDataFrame(rows, "interval string, pattern string, sample int, decided int, precision double")


def calibration_points(signals: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Adds sample, decided, precision and points (0 to 10) of the signal's pattern;
    neutral points where its profile is missing or rests on too few outcomes.

    `held` is a table of profiles, one row an interval and pattern (by default CALIBRATION)."""
    points = F
    for least, n in POINTS:
        points = points.when(F.col("precision") >= least, n)
    held = profiles(signals.sparkSession) if held is None else held
    enough = F.coalesce(F.col("decided") >= ENOUGH, F.lit(False))
    return signals.join(held, ["interval", "pattern"], "left").withColumn("points", F.when(enough, points.otherwise(0)).otherwise(NEUTRAL))


def horizon_guidance(family: Column, interval: Column) -> Column:
    """Label of the research window of an interval; none for wave signals and other intervals."""
    label = F
    for k, v in HORIZON_LABELS.items():
        label = label.when(interval == k, v)
    return F.when(~F.coalesce(family == "ELLIOTT", F.lit(False)), label.otherwise(None))


def _usable(price: str) -> Column:
    return F.coalesce((F.col(price) > 0) & (F.col(price) < float("inf")), F.lit(False))


def observed_outcome(events: DataFrame, bars: DataFrame, interval: str) -> DataFrame:
    """Fixed-horizon outcome of stored events of one interval, from completed bars.

    events: KEYS, family, size (bars of the pattern) and price (the stored close).
    status is SUCCESS, FAILURE or INCONCLUSIVE by the signed change from the stored
    price to the close of the horizon's last bar; PENDING, with the bars still
    missing, while the horizon is open; UNAVAILABLE for other families, without a
    usable price, or when the signal's bar is gone. Events that repeat a key keep
    all their rows.
    """
    held, move = B.HORIZONS[interval]
    ahead, longest = W().rowsBetween(1, held), 3
    spans = {f"{name}_{k}": f(c).over(W().rowsBetween(1 - k, 0)) for k in range(1, longest + 1) for name, f, c in (("top", F.max, "high"), ("bottom", F.min, "low"))}
    b = bars.filter(F.col("interval") == interval).withColumns(spans | {
        "left": F.count("*").over(ahead), "evaluation_ts": F.lead("ts", held).over(W()), "evaluation_close": F.lead("close", held).over(W()),
        "max_high": F.max("high").over(ahead), "min_low": F.min("low").over(ahead),
    }).drop("open", "high", "low", "close", "volume")
    df = events.filter(F.col("interval") == interval).join(b, ["symbol", "interval", "ts"], "left")
    by_size = lambda name: F.when(F.col("size") <= 1, F.col(f"{name}_1")).when(F.col("size") == 2, F.col(f"{name}_2")).otherwise(F.col(f"{name}_3"))
    change = lambda c: (F.col(c) - F.col("price")) / F.col("price") * 100.0
    sell = F.col("direction") == "SELL"
    known = _usable("price") & (F.col("family") == "CANDLESTICK") & F.col("left").isNotNull()
    done = known & (F.col("left") >= held)
    df = df.withColumn("change", F.when(done, F.when(sell, -change("evaluation_close")).otherwise(change("evaluation_close"))))
    gain = F.col("change") >= 0
    return df.select(
        *KEYS,
        F.when(~F.coalesce(known, F.lit(False)), "UNAVAILABLE").when(~done, "PENDING").otherwise(B.outcome(F.col("change"), move)).alias("status"),
        F.when(known & ~done, F.lit(held) - F.col("left")).alias("missing"),
        F.when(known, by_size("top")).alias("pattern_high"), F.when(known, by_size("bottom")).alias("pattern_low"),
        F.when(done, F.col("evaluation_ts")).alias("evaluation_ts"), F.when(done, F.col("evaluation_close")).alias("evaluation_close"), "change",
        F.when(done, F.when(sell, -change("min_low")).otherwise(change("max_high"))).alias("best_move"),
        F.when(done, F.when(sell, -change("max_high")).otherwise(change("min_low"))).alias("worst_move"),
        F.when(done, F.when(sell, F.when(gain, "LOSS_AVOIDED").otherwise("PRICE_ROSE")).otherwise(F.when(gain, "GAIN").otherwise("LOSS"))).alias("impact"),
    )


def signal_excursion(events: DataFrame, bars: DataFrame, window: int = 3) -> DataFrame:
    """Best and worst signed move over the bars after a signal, up to the bar that
    resolved it, and how many bars that are.

    events: KEYS (one row each), idx, price and resolution_offset (null while open).
    Without a usable price or a completed bar the moves are null and seen is 0.
    """
    f = B.forward_bars(events.select(*KEYS, "idx", "price", "resolution_offset"), bars, window)
    f = f.filter(_usable("price") & (F.col("offset") <= F.coalesce("resolution_offset", F.lit(window))) & F.col("f_high").isNotNull() & F.col("f_low").isNotNull())
    held = f.groupBy(*KEYS).agg(F.max("f_high").alias("top"), F.min("f_low").alias("bottom"), F.count("*").alias("n"))
    change = lambda c: (F.col(c) - F.col("price")) / F.col("price") * 100.0
    sell = F.col("direction") == "SELL"
    return events.select(*KEYS, "price", "resolution_offset").join(held, KEYS, "left").select(
        *KEYS, F.coalesce("n", F.lit(0)).alias("seen"), F.col("resolution_offset").isNotNull().alias("resolved"),
        F.when(sell, -change("bottom")).otherwise(change("top")).alias("best_move"),
        F.when(sell, -change("top")).otherwise(change("bottom")).alias("worst_move"),
    )


def signal_horizons(signals: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """One row a signal and horizon: the signed change from the signal's close to the
    close so many bars later. Needs a column close_<n> per horizon; open ones are left out."""
    rows = F.array(*[F.struct(F.lit(n).alias("horizon"), F.col(f"close_{n}").alias("exit_close")) for n in horizons])
    df = signals.withColumn("row", F.explode(rows)).filter("row.exit_close IS NOT NULL")
    change = (F.col("row.exit_close") - F.col("close")) / F.col("close") * 100.0
    return df.select(*KEYS, F.col("row.horizon").alias("horizon"), F.col("close").alias("entry_price"), F.col("row.exit_close").alias("exit_price"), B.signed(F.col("direction"), change).alias("change"))
