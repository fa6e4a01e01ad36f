"""Candlestick patterns and their scores, as expressions over one window.

Each bar carries its two predecessors as structs, so a pattern is a boolean
expression and all patterns come from one scan: an array of optional structs,
compacted and exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import indicators as I
from tidemark.operators.indicators import W

_KEPT = ("open", "high", "low", "close", "body", "range", "upper", "lower", "bull", "bear", "band_lower", "band_upper", "ema_fast", "ema_slow", "macd_histogram", "rsi", "cci", "vwap")
#: Bars of each pattern.
SIZES = {
    "DOJI": 1, "HAMMER": 1, "HANGING_MAN": 1, "SHOOTING_STAR": 1, "INVERTED_HAMMER": 1, "BULLISH_ENGULFING": 2, "BEARISH_ENGULFING": 2,
    "PIERCING_LINE": 2, "DARK_CLOUD_COVER": 2, "BULLISH_HARAMI": 2, "BEARISH_HARAMI": 2, "MORNING_STAR": 3, "EVENING_STAR": 3,
    "THREE_WHITE_SOLDIERS": 3, "THREE_BLACK_CROWS": 3,
}
# Tenths of a point that each family can give, and its raw maximum.
FAMILIES = {"quality": (250, 25), "trend": (200, 20), "higher": (50, 15), "momentum": (150, 15), "bands": (100, 10), "level": (150, 15), "volume": (100, 10)}


def prepared(bars: DataFrame, interval: str) -> DataFrame:
    """Enriched bars with anatomy, trends, baselines and the two bars before."""
    df = I.trend_at(I.anatomy(I.enrich(bars.filter("open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND ts IS NOT NULL AND high >= greatest(open, close) AND low <= least(open, close)"), interval)))
    for k in (1, 2, 3):
        df = I.body_baseline(I.prior_trend(df, k), k)
    bar = F.struct(*_KEPT)
    return df.withColumns({"c0": bar, "c1": F.lag(bar, 1).over(W()), "c2": F.lag(bar, 2).over(W())})


def _shape() -> dict[str, tuple[Column, str]]:
    c, p, f = (F.col(x) for x in ("c0", "c1", "c2"))
    trend = {k: F.col(f"trend_{k}") for k in (1, 2, 3)}

    def base(k):
        m, ok = F.col(f"median_body_{k}"), F.col(f"enough_{k}")
        return {
            "long": lambda x: ok & (x["body"] >= x["range"] * 0.55) & (x["body"] >= m * 1.1),
            "strong": lambda x: ok & (x["body"] >= x["range"] * 0.5) & (x["body"] >= m * 0.9),
            "small": lambda x: ok & (x["body"] <= x["range"] * 0.3) & (x["body"] <= m * 0.75),
            "inside": lambda a, b: ok & (b["body"] <= a["body"] * 0.45) & (b["body"] <= m * 0.75),
            "marching": lambda x: ok & (x["body"] >= x["range"] * 0.5) & (x["body"] >= m * 0.8),
        }

    two, three = base(2), base(3)
    hammer = (c["body"] >= c["range"] * 0.02) & (c["lower"] >= c["body"] * 2.0) & (c["upper"] <= c["body"] * 0.5) & (c["body"] <= c["range"] * 0.3)
    star = (c["body"] >= c["range"] * 0.02) & (c["upper"] >= c["body"] * 2.0) & (c["lower"] <= c["body"] * 0.5) & (c["body"] <= c["range"] * 0.3)
    swallow = (p["body"] >= p["range"] * 0.2) & (c["body"] >= p["body"]) & (c["body"] >= c["range"] * 0.45)
    mid, mid3 = (p["open"] + p["close"]) / 2.0, (f["open"] + f["close"]) / 2.0
    within = lambda a, b: (b["open"] >= F.least(a["open"], a["close"])) & (b["open"] <= F.greatest(a["open"], a["close"]))
    march = three["marching"](f) & three["marching"](p) & three["marching"](c) & within(f, p) & within(p, c)
    wick = lambda side: (f[side] <= f["body"] * 0.3) & (p[side] <= p["body"] * 0.3) & (c[side] <= c["body"] * 0.3)
    return {
        "DOJI": (c["body"] <= c["range"] * 0.1, "HOLD"),
        "HAMMER": (hammer & (trend[1] == "DOWN"), "BUY"),
        "HANGING_MAN": (hammer & (trend[1] == "UP"), "SELL"),
        "SHOOTING_STAR": (star & (trend[1] == "UP"), "SELL"),
        "INVERTED_HAMMER": (star & (trend[1] == "DOWN"), "BUY"),
        "BULLISH_ENGULFING": ((trend[2] == "DOWN") & p["bear"] & c["bull"] & swallow & (c["open"] <= p["close"]) & (c["close"] >= p["open"]), "BUY"),
        "BEARISH_ENGULFING": ((trend[2] == "UP") & p["bull"] & c["bear"] & swallow & (c["open"] >= p["close"]) & (c["close"] <= p["open"]), "SELL"),
        "PIERCING_LINE": ((trend[2] == "DOWN") & p["bear"] & c["bull"] & two["long"](p) & two["strong"](c) & (c["open"] < p["close"]) & (c["close"] > mid) & (c["close"] < p["open"]), "BUY"),
        "DARK_CLOUD_COVER": ((trend[2] == "UP") & p["bull"] & c["bear"] & two["long"](p) & two["strong"](c) & (c["open"] > p["close"]) & (c["close"] < mid) & (c["close"] > p["open"]), "SELL"),
        "BULLISH_HARAMI": ((trend[2] == "DOWN") & p["bear"] & c["bull"] & two["long"](p) & (c["open"] >= p["close"]) & (c["close"] <= p["open"]) & two["inside"](p, c), "BUY"),
        "BEARISH_HARAMI": ((trend[2] == "UP") & p["bull"] & c["bear"] & two["long"](p) & (c["open"] <= p["close"]) & (c["close"] >= p["open"]) & two["inside"](p, c), "SELL"),
        "MORNING_STAR": ((trend[3] == "DOWN") & f["bear"] & c["bull"] & three["long"](f) & three["small"](p) & three["strong"](c) & (c["close"] > mid3), "BUY"),
        "EVENING_STAR": ((trend[3] == "UP") & f["bull"] & c["bear"] & three["long"](f) & three["small"](p) & three["strong"](c) & (c["close"] < mid3), "SELL"),
        "THREE_WHITE_SOLDIERS": (trend[3].isin("DOWN", "BASE") & f["bull"] & p["bull"] & c["bull"] & march & (p["close"] > f["close"]) & (c["close"] > p["close"]) & wick("upper"), "BUY"),
        "THREE_BLACK_CROWS": ((trend[3] == "UP") & f["bear"] & p["bear"] & c["bear"] & march & (p["close"] < f["close"]) & (c["close"] < p["close"]) & wick("lower"), "SELL"),
    }


def detected(prepared: DataFrame, only: tuple[str, ...] = (), hold: bool = True) -> DataFrame:
    """One row per bar and pattern that ends on it: adds pattern, direction, size."""
    found = [
        F.when((F.col("idx") >= 2) & F.coalesce(rule, F.lit(False)), F.struct(F.lit(name).alias("pattern"), F.lit(side).alias("direction"), F.lit(SIZES[name]).alias("size")))
        for name, (rule, side) in _shape().items()
        if (not only or name in only) and (hold or side != "HOLD")
    ]
    df = prepared.withColumn("hit", F.explode(F.array_compact(F.array(*found))))
    return df.withColumns({k: F.col(f"hit.{k}") for k in ("pattern", "direction", "size")}).drop("hit")


# ------------------------------------------------------------------- scores


def _by_size(name: str) -> Column:
    return F.when(F.col("size") == 1, F.col(f"{name}_1")).when(F.col("size") == 2, F.col(f"{name}_2")).otherwise(F.col(f"{name}_3"))


def _pts(*cases: tuple[Column, int]) -> Column:
    out = F
    for cond, n in cases:
        out = out.when(cond, n)
    return out.otherwise(0)


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")


def _buy() -> Column:
    return F.col("direction") == "BUY"


def _toward(delta: Column) -> Column:
    """Whether a change points the signal's way (false when unavailable)."""
    return F.coalesce(F.when(_buy(), delta > 0).otherwise(delta < 0), F.lit(False))


def _first() -> Column:
    return F.when(F.col("size") == 1, F.col("c0")).when(F.col("size") == 2, F.col("c1")).otherwise(F.col("c2"))


def score_geometry() -> Column:
    c, p, f, a = F.col("c0"), F.col("c1"), F.col("c2"), _first()
    name = F.col("pattern")
    long3 = lambda side: F.when((c["body"] >= c["range"] * 0.65) & (p["body"] >= p["range"] * 0.65) & (f["body"] >= f["range"] * 0.65), 3).otherwise(0) + F.when((c[side] <= c["body"] * 0.15) & (p[side] <= p["body"] * 0.15) & (f[side] <= f["body"] * 0.15), 2).otherwise(0)
    gap = F.when(name == "MORNING_STAR", F.greatest(p["open"], p["close"]) < F.least(f["open"], f["close"])).otherwise(F.least(p["open"], p["close"]) > F.greatest(f["open"], f["close"]))
    pierced = F.when(a["body"] == 0, 0.0).otherwise(F.abs(c["close"] - a["close"]) / a["body"])
    extra = (
        F.when(name.isin("HAMMER", "HANGING_MAN"), _pts((c["lower"] >= c["body"] * 3.0, 3)) + _pts((c["upper"] <= c["range"] * 0.1, 2)))
        .when(name.isin("INVERTED_HAMMER", "SHOOTING_STAR"), _pts((c["upper"] >= c["body"] * 3.0, 3)) + _pts((c["lower"] <= c["range"] * 0.1, 2)))
        .when(name.endswith("ENGULFING"), _pts((c["body"] >= a["body"] * 1.25, 3)) + _pts((c["body"] >= c["range"] * 0.6, 2)))
        .when(name.endswith("HARAMI"), _pts((F.col("enough_2") & (a["body"] >= F.col("median_body_2") * 1.4), 3)) + _pts((c["body"] <= a["body"] * 0.25, 2)))
        .when(name.isin("PIERCING_LINE", "DARK_CLOUD_COVER"), _pts((pierced >= 0.65, 3)) + _pts((c["body"] >= c["range"] * 0.6, 2)))
        .when(name.endswith("_STAR"), _pts((gap, 2)) + _pts((c["body"] >= f["body"] * 0.8, 3)))
        .when(name == "THREE_WHITE_SOLDIERS", long3("upper")).when(name == "THREE_BLACK_CROWS", long3("lower")).otherwise(5)
    )
    return F.least(F.lit(20) + extra, F.lit(25)).cast("int")


def score_quality() -> Column:
    return _half_up(F.col("geometry") * 10.0 / 25.0) + _half_up(_by_size("trend_points") * 15.0 / 25.0)


def score_trend() -> Column:
    p = F.col("c1")
    both = F.col("ema_fast").isNotNull() & F.col("ema_slow").isNotNull()
    return (
        _pts((both & _toward(F.col("ema_fast") - F.col("ema_slow")), 5)) + _pts((both & _toward(F.col("ema_fast") - p["ema_fast"]), 3))
        + _pts((both & _toward(F.col("ema_slow") - p["ema_slow"]), 2)) + _pts((_toward(F.col("close") - F.col("sma_long")), 4))
        + _pts((_toward(F.col("macd") - F.col("macd_signal")), 3)) + _pts((_toward(F.col("macd_histogram") - p["macd_histogram"]), 3))
    )


def score_momentum() -> Column:
    r, c, p = F.col("rsi"), F.col("cci"), F.col("c1")
    level = F.when(_buy(), _pts((r <= 35, 5), (r < 45, 3), (r < 50, 1))).otherwise(_pts((r >= 65, 5), (r > 55, 3), (r > 50, 1)))
    far = F.when(_buy(), _pts((c <= -100, 4), (c <= -50, 2))).otherwise(_pts((c >= 100, 4), (c >= 50, 2)))
    return level + _pts((_toward(r - p["rsi"]), 3)) + far + _pts((_toward(c - p["cci"]), 3))


def score_bands() -> Column:
    touch = lambda x: F.coalesce(F.when(_buy(), x["low"] <= x["band_lower"] * 1.005).otherwise(x["high"] >= x["band_upper"] * 0.995), F.lit(False))
    tested = touch(F.col("c0")) | ((F.col("size") >= 2) & touch(F.col("c1"))) | ((F.col("size") >= 3) & touch(F.col("c2")))
    low, high, close = F.col("band_lower"), F.col("band_upper"), F.col("close")
    b = F.when(high > low, (close - low) / (high - low))
    place = F.when(_buy(), _pts((b <= 0.20, 4), (b <= 0.35, 2))).otherwise(_pts((b >= 0.80, 4), (b >= 0.65, 2)))
    back = tested & b.isNotNull() & F.when(_buy(), close > low).otherwise(close < high)
    return _pts((tested, 4)) + place + _pts((back, 2))


def scale() -> Column:
    return F.when(F.col("atr") > 0, F.col("atr")).otherwise(F.greatest(F.abs(F.col("close")) * 0.01, F.lit(0.000001)))


def with_levels(prepared: DataFrame) -> DataFrame:
    """For patterns of k bars: the lows and highs of up to 20 bars before, and the pattern's extremes."""
    df = prepared
    for k in (1, 2, 3):
        w = W().rowsBetween(-k - 19, -k)
        df = df.withColumns({f"_lows_{k}": F.collect_list("low").over(w), f"_highs_{k}": F.collect_list("high").over(w), f"_min_{k}": F.min("low").over(I.last(k)), f"_max_{k}": F.max("high").over(I.last(k))})
    return df


def score_level() -> Column:
    lows, highs = _by_size("_lows"), _by_size("_highs")
    low, high = _by_size("_min"), _by_size("_max")
    before = F.when(_buy(), lows).otherwise(highs)
    level = F.when(_buy(), F.array_min(before)).otherwise(F.array_max(before))
    edge = F.when(_buy(), low).otherwise(high)
    off = F.abs(edge - level) / scale()
    touches = F.size(F.filter(before, lambda x: F.abs(x - level) <= scale() * 0.5))
    span = F.greatest(high - low, F.lit(0.000001))
    back = F.when(_buy(), (F.col("close") - low) / span).otherwise((high - F.col("close")) / span)
    points = _pts((off <= 0.25, 7), (off <= 0.50, 5), (off <= 1.0, 3)) + _pts((touches >= 3, 4), (touches == 2, 2), (touches == 1, 1)) + _pts((back >= 0.65, 4), (back >= 0.50, 2))
    return F.when(F.size(before) == 0, 0).otherwise(points)


def score_volume() -> Column:
    ratio = F.when(F.col("average_volume") > 0, F.col("volume") / F.col("average_volume"))
    poc, close = F.col("poc"), F.col("close")
    edge = F.when(_buy(), F.col("value_low")).otherwise(F.col("value_high"))
    near = F.abs(close - edge) / scale()
    side = F.coalesce(F.when(_buy(), close <= poc).otherwise(close >= poc), F.lit(False))
    return (
        _pts((ratio >= 1.5, 4), (ratio >= 1.2, 3), (ratio >= 1.0, 2)) + _pts((_toward(close - F.col("vwap")), 2)) + _pts((_toward(F.col("vwap") - F.col("c1.vwap")), 1))
        + _pts((side, 1)) + _pts((near <= 0.5, 2), (near <= 1.0, 1))
    )


def _before(field: str, period: Column) -> Column:
    return F.filter("_seen", lambda x: x[field] < period)


def _ends(d: Column, field: str) -> Column:
    """Closes of the bars after which the period changes, and of the last bar."""
    ends = F.transform(d, lambda x, j: F.when((j == F.size(d) - 1) | (F.get(d, j + 1)[field] != x[field]), x["close"]))
    return F.filter(ends, lambda x: x.isNotNull())


def with_higher(prepared: DataFrame, interval: str) -> DataFrame:
    """_h1, _h2: closes of the completed larger periods among the last 100 bars, oldest first."""
    units = {"1d": ("week", "month"), "1wk": ("month",), "1mo": ("quarter",)}[interval]
    df = prepared.withColumn("_seen", F.collect_list(F.struct(*[F.date_trunc(u, "ts").alias(f"p{i}") for i, u in enumerate(units)], "close")).over(I.last(100)))
    for i, u in enumerate(units):
        df = df.withColumn(f"_d{i}", _before(f"p{i}", F.date_trunc(u, F.col("ts"))))
        df = df.withColumn(f"_h{i}", _ends(F.col(f"_d{i}"), f"p{i}")).drop(f"_d{i}")
    return df.drop("_seen")


def score_higher(interval: str) -> Column:
    total = F.lit(0)
    for i, most in enumerate({"1d": (8, 7), "1wk": (15,), "1mo": (15,)}[interval]):
        h = F.col(f"_h{i}")
        n = F.size(h)
        m = F.least(F.lit(5), n - 1)
        mean = lambda end: F.aggregate(F.slice(h, F.greatest(end - m + 1, F.lit(1)), F.greatest(m, F.lit(1))), F.lit(0.0), lambda a, x: a + x) / m  # noqa: E731, B023
        price, slope = (most + 1) // 2, most - (most + 1) // 2
        pts = _pts((_toward(F.element_at(h, -1) - mean(n)), price)) + _pts((_toward(mean(n) - mean(n - 1)), slope))
        total = total + F.when(n < 4, 0).otherwise(pts)
    return total


def scored(prepared: DataFrame, interval: str) -> DataFrame:
    """Detected directional patterns with the seven family scores (raw), setup_score and strength."""
    df = detected(with_higher(with_levels(prepared), interval), hold=False)
    df = df.withColumn("geometry", score_geometry())
    df = df.withColumns({"quality": score_quality(), "trend": score_trend(), "higher": score_higher(interval), "momentum": score_momentum(), "bands": score_bands(), "level": score_level(), "volume_points": score_volume()})
    raw = {"quality": "quality", "trend": "trend", "higher": "higher", "momentum": "momentum", "bands": "bands", "level": "level", "volume": "volume_points"}
    tenths = sum((_half_up(F.greatest(F.lit(0), F.least(F.col(raw[k]), F.lit(most))) * tenth / float(most)) for k, (tenth, most) in FAMILIES.items()), F.lit(0))
    df = df.withColumn("setup_score", F.least(F.lit(100), _half_up(tenths / 10.0)))
    return df.withColumn("strength", band(F.col("setup_score"))).drop(*[f"_{n}_{k}" for n in ("lows", "highs", "min", "max") for k in (1, 2, 3)])


def band(score: Column) -> Column:
    return F.when(score < 75, "LOW").when(score < 85, "MEDIUM").otherwise("HIGH")
