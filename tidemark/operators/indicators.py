"""Indicators and bar anatomy as window expressions.

Everything runs over one window, per symbol and interval in order of time, so one
exchange serves all. Recursive averages take the whole history (see recursive).
Values are null until enough bars exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.recursive import with_averages

# Periods per interval.
PROFILES = {
    "1d": {"rsi": 14, "fast": 20, "slow": 50, "sma": 200, "macd": (12, 26, 9), "cci": 20, "atr": 14, "band": 20, "volume": 20, "vwap": 20, "profile": 60},
    "1wk": {"rsi": 10, "fast": 8, "slow": 21, "sma": 40, "macd": (8, 21, 5), "cci": 14, "atr": 10, "band": 13, "volume": 13, "vwap": 13, "profile": 26},
    "1mo": {"rsi": 9, "fast": 6, "slow": 12, "sma": 24, "macd": (6, 12, 4), "cci": 12, "atr": 9, "band": 12, "volume": 12, "vwap": 12, "profile": 24},
}
PROFILE_BINS, VALUE_AREA = 24, 0.70


def W():
    """A symbol's bars of an interval, in order of time."""
    return Window.partitionBy("symbol", "interval").orderBy("ts")


def last(n: int):
    return W().rowsBetween(-(n - 1), 0)


def indexed(bars: DataFrame) -> DataFrame:
    """Adds idx, from 1."""
    return bars.withColumn("idx", F.row_number().over(W()))


def gated(value: Column, least: int) -> Column:
    return F.when(F.col("idx") >= least, value)


def sma(c: Column, n: int) -> Column:
    return gated(F.avg(c).over(last(n)), n)


def smoothing(n: int) -> float:
    """Factor of an exponential average of n bars."""
    return 2.0 / (n + 1)


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / F.lit(3.0)


# What averages are taken of.


def gain_and_loss() -> tuple[Column, Column]:
    move = F.coalesce(F.col("close") - F.lag("close").over(W()), F.lit(0.0))
    return F.greatest(move, F.lit(0.0)), F.greatest(-move, F.lit(0.0))


def true_range() -> Column:
    before, span = F.lag("close").over(W()), F.col("high") - F.col("low")
    return F.coalesce(F.greatest(span, F.abs(F.col("high") - before), F.abs(F.col("low") - before)), span)


def with_recursive(df: DataFrame, emas: dict[str, int] | None = None, rsi: int = 0, macd: tuple[int, int, int] | None = None, atr: int = 0) -> DataFrame:
    """All averages of the close, rsi, macd and atr in one scan (macd's signal in a second one)."""
    emas, series, close = emas or {}, {}, F.col("close")
    if rsi:
        gain, loss = gain_and_loss()
        df = df.withColumns({"_gain": gain, "_loss": loss})
        series |= {"_gains": (F.col("_gain"), 1.0 / rsi), "_losses": (F.col("_loss"), 1.0 / rsi)}
    if atr:
        df = df.withColumn("_range", true_range())
        series["atr"] = (F.col("_range"), 1.0 / atr)
    fast, slow, signal = macd or (0, 0, 0)
    periods = dict.fromkeys([*emas.values(), *([fast, slow] if macd else [])])
    series |= {f"_ema{n}": (close, smoothing(n)) for n in periods}
    df = with_averages(df, series)
    out = {k: gated(F.col(f"_ema{n}"), n) for k, n in emas.items()}
    if atr:
        out["atr"] = gated(F.col("atr"), atr + 1)
    if rsi:
        g, x = F.col("_gains"), F.col("_losses")
        out["rsi"] = gated(F.when(x == 0, F.when(g == 0, 0.0).otherwise(100.0)).otherwise(100.0 - 100.0 / (1.0 + g / x)), rsi + 1)
    if macd:
        df = df.withColumn("_line", F.col(f"_ema{fast}") - F.col(f"_ema{slow}"))
        df = with_averages(df, {"_signal": (F.col("_line"), smoothing(signal))})
        line, least = F.col("_line"), slow + signal - 1
        out |= {"macd": gated(line, slow), "macd_signal": gated(F.col("_signal"), least), "macd_histogram": gated(line - F.col("_signal"), least)}
    return df.withColumns(out).drop("_gain", "_loss", "_range", "_gains", "_losses", "_line", "_signal", *[f"_ema{n}" for n in periods])


def with_emas(df: DataFrame, **periods: int) -> DataFrame:
    """Named exponential averages of the close."""
    return with_recursive(df, emas=periods)


def with_rsi(df: DataFrame, n: int) -> DataFrame:
    return with_recursive(df, rsi=n)


def with_macd(df: DataFrame, fast: int, slow: int, signal: int) -> DataFrame:
    return with_recursive(df, macd=(fast, slow, signal))


def with_atr(df: DataFrame, n: int) -> DataFrame:
    return with_recursive(df, atr=n)


def with_cci(df: DataFrame, n: int) -> DataFrame:
    df = df.withColumn("_tp", typical())
    df = df.withColumn("_tps", F.collect_list("_tp").over(last(n))).withColumn("_mean", F.avg("_tp").over(last(n)))
    off = F.aggregate(F.transform("_tps", lambda x: F.abs(x - F.col("_mean"))), F.lit(0.0), lambda a, x: a + x) / F.lit(float(n))
    df = df.withColumn("_off", off)
    value = F.when(F.col("_off") == 0, 0.0).otherwise((F.col("_tp") - F.col("_mean")) / (0.015 * F.col("_off")))
    return df.withColumn("cci", gated(value, n)).drop("_tp", "_tps", "_mean", "_off")


def with_bands(df: DataFrame, n: int, width: float = 2.0) -> DataFrame:
    middle, off = F.avg("close").over(last(n)), F.stddev_pop("close").over(last(n))
    return df.withColumns({"band_middle": gated(middle, n), "band_upper": gated(middle + width * off, n), "band_lower": gated(middle - width * off, n)})


def vwap(n: int) -> Column:
    volume = F.sum(F.col("volume").cast("double")).over(last(n))
    return gated(F.when(volume > 0, F.sum(typical() * F.col("volume")).over(last(n)) / volume), n)


def with_volume_profile(df: DataFrame, n: int, bins: int = PROFILE_BINS, area: float = VALUE_AREA) -> DataFrame:
    """poc, value_low, value_high of the last n bars' volume by price, spread
    equally over the bins a bar touches; the value area grows to the larger
    neighbour, downwards on a tie."""
    df = df.withColumn("_bars", F.collect_list(F.struct("low", "high", F.greatest(F.col("volume"), F.lit(0)).cast("double").alias("v"))).over(last(n)))
    df = df.withColumn("_lo", F.min("low").over(last(n))).withColumn("_hi", F.max("high").over(last(n)))
    df = df.withColumn("_w", (F.col("_hi") - F.col("_lo")) / F.lit(float(bins)))
    at = lambda p: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((p - F.col("_lo")) / F.col("_w")).cast("int")))
    df = df.withColumn("_spans", F.when(F.col("_w") > 0, F.transform("_bars", lambda b: F.struct(at(b["low"]).alias("a"), at(b["high"]).alias("b"), b["v"].alias("v")))))
    share = lambda s, k: F.when((s["a"] <= k) & (s["b"] >= k), s["v"] / (s["b"] - s["a"] + 1)).otherwise(0.0)
    df = df.withColumn("_vol", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.aggregate("_spans", F.lit(0.0), lambda a, s: a + share(s, k))))
    df = df.withColumn("_all", F.aggregate("_bars", F.lit(0.0), lambda a, b: a + b["v"]))
    df = df.withColumn("_top", (F.array_position("_vol", F.array_max("_vol")) - 1).cast("int"))
    vol = F.col("_vol")
    lower, upper = (lambda s: F.coalesce(F.when(s["lo"] > 0, F.get(vol, s["lo"] - 1)), F.lit(-1.0))), (lambda s: F.coalesce(F.when(s["hi"] < bins - 1, F.get(vol, s["hi"] + 1)), F.lit(-1.0)))

    def grow(s, _):
        more = (s["v"] < F.col("_all") * area) & ((s["lo"] > 0) | (s["hi"] < bins - 1))
        up = upper(s) > lower(s)
        return F.struct(
            F.when(more & ~up, s["lo"] - 1).otherwise(s["lo"]).alias("lo"), F.when(more & up, s["hi"] + 1).otherwise(s["hi"]).alias("hi"),
            F.when(more, s["v"] + F.when(up, upper(s)).otherwise(lower(s))).otherwise(s["v"]).alias("v"),
        )

    start = F.struct(F.col("_top").alias("lo"), F.col("_top").alias("hi"), F.get(vol, F.col("_top")).alias("v"))
    df = df.withColumn("_area", F.aggregate(F.sequence(F.lit(1), F.lit(bins)), start, grow))
    flat, ok = F.col("_w") == 0, (F.col("idx") >= n) & (F.col("_all") > 0)
    return df.withColumns({
        "poc": F.when(ok, F.when(flat, F.col("_lo")).otherwise(F.col("_lo") + (F.col("_top") + 0.5) * F.col("_w"))),
        "value_low": F.when(ok, F.when(flat, F.col("_lo")).otherwise(F.col("_lo") + F.col("_area.lo") * F.col("_w"))),
        "value_high": F.when(ok, F.when(flat, F.col("_hi")).otherwise(F.col("_lo") + (F.col("_area.hi") + 1.0) * F.col("_w"))),
    }).drop("_bars", "_lo", "_hi", "_w", "_spans", "_vol", "_all", "_top", "_area")


def enrich(bars: DataFrame, interval: str, latest: int | None = None) -> DataFrame:
    """All indicators of the interval's profile, for one interval's bars."""
    p = PROFILES[interval]
    df = with_recursive(indexed(bars), {"ema_fast": p["fast"], "ema_slow": p["slow"]}, p["rsi"], p["macd"], p["atr"])
    df = df.withColumns({"sma_long": sma(F.col("close"), p["sma"]), "average_volume": sma(F.col("volume"), p["volume"]), "vwap": vwap(p["vwap"])})
    df = with_bands(with_cci(df, p["cci"]), p["band"])
    df = with_volume_profile(df, p["profile"])
    if latest:
        newest = Window.partitionBy("symbol", "interval").orderBy(F.desc("ts"))
        df = df.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= latest).drop("_n")
    return df


def required_history(latest: int) -> dict[str, int]:
    """Bars to load for `latest` bars with every indicator available."""
    longest = lambda p: max(p["rsi"] + 1, p["slow"], p["sma"], p["macd"][1] + p["macd"][2] - 1, p["cci"], p["atr"] + 1, p["band"], p["profile"])
    return {k: latest + longest(p) - 1 for k, p in PROFILES.items()}


def anatomy(df: DataFrame) -> DataFrame:
    """body, range (at least 1e-6), upper and lower shadow, bullish, bearish."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return df.withColumns({
        "body": F.abs(F.col("close") - F.col("open")), "range": F.greatest(F.col("high") - F.col("low"), F.lit(0.000001)),
        "upper": F.greatest(F.lit(0.0), F.col("high") - top), "lower": F.greatest(F.lit(0.0), bottom - F.col("low")),
        "bull": F.col("close") > F.col("open"), "bear": F.col("close") < F.col("open"),
    })


def middle(values: Column) -> Column:
    """Median of a list (0 of an empty one); median() takes no frame."""
    s, n = F.array_sort(values), F.size(values)
    return F.when(n == 0, 0.0).otherwise((F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)


def body_baseline(df: DataFrame, k: int) -> DataFrame:
    """median_body_k, median_range_k, enough_k of up to 20 bars before a pattern of k bars."""
    w = W().rowsBetween(-k - 19, -k)
    df = df.withColumns({"_bodies": F.collect_list("body").over(w), "_ranges": F.collect_list("range").over(w)})
    df = df.withColumns({f"median_body_{k}": middle(F.col("_bodies")), f"median_range_{k}": middle(F.col("_ranges")), f"_n{k}": F.size("_bodies")}).drop("_bodies", "_ranges")
    return df.withColumn(f"enough_{k}", (F.col(f"_n{k}") >= 3) & (F.col(f"median_body_{k}") > 0) & (F.col(f"median_range_{k}") > 0)).drop(f"_n{k}")


def trend_at(df: DataFrame) -> DataFrame:
    """The trend of the (up to) five bars that end at each bar: t_dir, t_points.

    Patterns of k bars take it k bars earlier.
    """
    w = last(5)
    close, high, low = F.col("close"), F.col("high"), F.col("low")
    pc, ph, pl = (F.lag(c).over(W()) for c in ("close", "high", "low"))
    df = df.withColumns({
        "_up": (close > pc).cast("int"), "_dn": (close < pc).cast("int"), "_hh": ((high > ph) & (low > pl)).cast("int"),
        "_ll": ((high < ph) & (low < pl)).cast("int"), "_mv": F.abs(close - pc),
    })
    steps = W().rowsBetween(-3, 0)
    total = {k: F.sum(f"_{k}").over(steps) for k in ("up", "dn", "hh", "ll", "mv")}
    df = df.withColumns({f"_s{k}": F.coalesce(c, F.lit(0)) for k, c in total.items()} | {"_c": F.count("close").over(w), "_first": F.first("close").over(w), "_top": F.max("high").over(w), "_bottom": F.min("low").over(w)})
    pe = F.lag("ema_fast").over(W())
    for name, sign in (("_emaup", 1), ("_emadn", -1)):
        side = (close - F.col("ema_fast")) * sign > 0
        df = df.withColumn(name, F.coalesce(F.when(F.col("ema_fast").isNull(), False).when(~side | pe.isNull(), side).otherwise((F.col("ema_fast") - pe) * sign > 0), F.lit(False)))
    n, net = F.col("_c") - 1, close - F.col("_first")
    need, least = F.ceil(n * 0.6), F.greatest(F.abs(F.col("_first")) * 0.015, F.lit(0.000001))
    path = F.when(F.col("_smv") > 0, F.abs(net) / F.col("_smv")).otherwise(0.0)
    up = (net >= least) & ((F.col("_shh") >= need) | ((F.col("_sup") >= need) & (path >= 0.35)))
    down = (-net >= least) & ((F.col("_sll") >= need) | ((F.col("_sdn") >= need) & (path >= 0.35)))
    base = (F.abs(net) < least) & (F.col("_sup") > 0) & (F.col("_sdn") > 0) & (F.col("_top") - F.col("_bottom") <= F.greatest(F.abs(F.col("_first")) * 0.04, F.lit(0.000001)))

    def points(closes, structure, aligned):
        s, c, m = F.col(structure) / n, F.col(closes) / n, F.abs(net) / least
        p = F.lit(14) + F.when(s >= 0.75, 4).when(s >= 0.5, 2).otherwise(0) + F.when(c >= 0.75, 3).when(c >= 0.5, 1).otherwise(0)
        return F.least(p + F.when(m >= 2.0, 3).when(m >= 1.5, 2).otherwise(1) + F.col(aligned).cast("int"), F.lit(25))

    enough = F.col("_c") >= 3
    df = df.withColumns({
        "t_dir": F.when(enough & up, "UP").when(enough & down, "DOWN").when(enough & base, "BASE").otherwise("NONE"),
        "t_points": F.when(enough & up, points("_sup", "_shh", "_emaup")).when(enough & down, points("_sdn", "_sll", "_emadn")).when(enough & base, 15).otherwise(0),
    })
    return df.drop(*[c for c in df.columns if c.startswith("_s")], "_up", "_dn", "_hh", "_ll", "_mv", "_c", "_first", "_top", "_bottom")


def prior_trend(df: DataFrame, k: int) -> DataFrame:
    """trend_k and trend_points_k before a pattern of k bars; needs trend_at."""
    return df.withColumns({f"trend_{k}": F.coalesce(F.lag("t_dir", k).over(W()), F.lit("NONE")), f"trend_points_{k}": F.coalesce(F.lag("t_points", k).over(W()), F.lit(0))})
