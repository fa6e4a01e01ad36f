"""Queries of candlestick patterns and scores, on weekly bars, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import patterns as P
from tidemark.plans import indicators as X
from tidemark.plans import sql as S
from tidemark.plans.catalog import query
from tidemark.sources import market as M

_LAGS = [c for c in P._KEPT]
PREP = (
    *X.BASE, *X.ENRICHED, "n0 AS (SELECT * FROM x)", X.ANATOMY.replace("FROM b)", "FROM n0)"), X.baseline_sql(1), X.baseline_sql(2), X.baseline_sql(3),
    X.TREND, X.prior_sql(1), X.prior_sql(2), X.prior_sql(3),
    "y AS (SELECT n.*, " + ", ".join(f"trend_{k}, trend_points_{k}, median_body_{k}, coalesce(enough_{k}, false) AS enough_{k}" for k in (1, 2, 3)) + ", "
    + ", ".join(f"lag(n.{c}) OVER w AS p_{c}, lag(n.{c}, 2) OVER w AS f_{c}" for c in _LAGS)
    + " FROM n " + " ".join(f"JOIN k{k} USING (symbol, ts) JOIN p{k} USING (symbol, ts)" for k in (1, 2, 3)) + " WINDOW w AS (PARTITION BY n.symbol ORDER BY n.ts))",
)


def _long(x, k):
    return f"(enough_{k} AND {x}body >= {x}range * 0.55 AND {x}body >= median_body_{k} * 1.1)"


def _strong(x, k):
    return f"(enough_{k} AND {x}body >= {x}range * 0.5 AND {x}body >= median_body_{k} * 0.9)"


def _march(x):
    return f"(enough_3 AND {x}body >= {x}range * 0.5 AND {x}body >= median_body_3 * 0.8)"


_IN = "({b}open >= least({a}open, {a}close) AND {b}open <= greatest({a}open, {a}close))"
_SWALLOW = "p_body >= p_range * 0.2 AND body >= p_body AND body >= range * 0.45"
_SMALL = "(enough_3 AND p_body <= p_range * 0.3 AND p_body <= median_body_3 * 0.75)"
_INSIDE = "(enough_2 AND body <= p_body * 0.45 AND body <= median_body_2 * 0.75)"
_MARCH = f"{_march('f_')} AND {_march('p_')} AND {_march('')} AND {_IN.format(a='f_', b='p_')} AND {_IN.format(a='p_', b='')}"
_HAMMER = "body >= range * 0.02 AND lower >= body * 2 AND upper <= body * 0.5 AND body <= range * 0.3"
_STAR = "body >= range * 0.02 AND upper >= body * 2 AND lower <= body * 0.5 AND body <= range * 0.3"
RULES = {
    "DOJI": ("body <= range * 0.1", "HOLD"),
    "HAMMER": (f"{_HAMMER} AND trend_1 = 'DOWN'", "BUY"),
    "HANGING_MAN": (f"{_HAMMER} AND trend_1 = 'UP'", "SELL"),
    "SHOOTING_STAR": (f"{_STAR} AND trend_1 = 'UP'", "SELL"),
    "INVERTED_HAMMER": (f"{_STAR} AND trend_1 = 'DOWN'", "BUY"),
    "BULLISH_ENGULFING": (f"trend_2 = 'DOWN' AND p_bear AND bull AND {_SWALLOW} AND open <= p_close AND close >= p_open", "BUY"),
    "BEARISH_ENGULFING": (f"trend_2 = 'UP' AND p_bull AND bear AND {_SWALLOW} AND open >= p_close AND close <= p_open", "SELL"),
    "PIERCING_LINE": (f"trend_2 = 'DOWN' AND p_bear AND bull AND {_long('p_', 2)} AND {_strong('', 2)} AND open < p_close AND close > (p_open + p_close) / 2 AND close < p_open", "BUY"),
    "DARK_CLOUD_COVER": (f"trend_2 = 'UP' AND p_bull AND bear AND {_long('p_', 2)} AND {_strong('', 2)} AND open > p_close AND close < (p_open + p_close) / 2 AND close > p_open", "SELL"),
    "BULLISH_HARAMI": (f"trend_2 = 'DOWN' AND p_bear AND bull AND {_long('p_', 2)} AND open >= p_close AND close <= p_open AND {_INSIDE}", "BUY"),
    "BEARISH_HARAMI": (f"trend_2 = 'UP' AND p_bull AND bear AND {_long('p_', 2)} AND open <= p_close AND close >= p_open AND {_INSIDE}", "SELL"),
    "MORNING_STAR": (f"trend_3 = 'DOWN' AND f_bear AND bull AND {_long('f_', 3)} AND {_SMALL} AND {_strong('', 3)} AND close > (f_open + f_close) / 2", "BUY"),
    "EVENING_STAR": (f"trend_3 = 'UP' AND f_bull AND bear AND {_long('f_', 3)} AND {_SMALL} AND {_strong('', 3)} AND close < (f_open + f_close) / 2", "SELL"),
    "THREE_WHITE_SOLDIERS": (f"trend_3 IN ('DOWN', 'BASE') AND f_bull AND p_bull AND bull AND {_MARCH} AND p_close > f_close AND close > p_close AND f_upper <= f_body * 0.3 AND p_upper <= p_body * 0.3 AND upper <= body * 0.3", "BUY"),
    "THREE_BLACK_CROWS": (f"trend_3 = 'UP' AND f_bear AND p_bear AND bear AND {_MARCH} AND p_close < f_close AND close < p_close AND f_lower <= f_body * 0.3 AND p_lower <= p_body * 0.3 AND lower <= body * 0.3", "SELL"),
}
DETECTED = "d AS (" + " UNION ALL ".join(f"SELECT *, '{k}' AS pattern, '{side}' AS direction, {P.SIZES[k]} AS size FROM y WHERE idx >= 2 AND ({rule})" for k, (rule, side) in RULES.items()) + ")"
COLUMNS = ["symbol", "interval", "ts", "pattern", "direction"]


def prepared(spark, sf_dir, interval="1wk"):
    return P.prepared(M.bars(spark, sf_dir, interval), interval)


def _sql(only=(), hold=True):
    names = ", ".join(f"'{n}'" for n in only) if only else None
    where = (f" WHERE pattern IN ({names})" if names else "") or (" WHERE direction <> 'HOLD'" if not hold else "")
    return S.over(*PREP, DETECTED, body='SELECT symbol, "interval", ts, pattern, direction FROM d' + where)


def _add(key, only=(), hold=True):
    @query(key, _sql(only, hold))
    def run(spark, sf_dir):
        return P.detected(prepared(spark, sf_dir), only, hold).select(*COLUMNS)


for _key, _only in {
    "pat_doji": ("DOJI",), "pat_hammer": ("HAMMER", "HANGING_MAN"), "pat_shooting_star": ("SHOOTING_STAR", "INVERTED_HAMMER"),
    "pat_engulfing": ("BULLISH_ENGULFING", "BEARISH_ENGULFING"), "pat_piercing": ("PIERCING_LINE", "DARK_CLOUD_COVER"),
    "pat_harami": ("BULLISH_HARAMI", "BEARISH_HARAMI"), "pat_star": ("MORNING_STAR", "EVENING_STAR"), "pat_three": ("THREE_WHITE_SOLDIERS", "THREE_BLACK_CROWS"),
}.items():
    _add(_key, _only)
_add("detect_patterns")
_add("detect_alert_patterns", hold=False)


# ------------------------------------------------------------------- scores

_A = {"body": "CASE size WHEN 1 THEN body WHEN 2 THEN p_body ELSE f_body END", "close": "CASE size WHEN 1 THEN close WHEN 2 THEN p_close ELSE f_close END"}


def _pt(cond, n):
    return f"CASE WHEN {cond} THEN {n} ELSE 0 END"


def _to(a, b="0"):
    return f"coalesce(CASE WHEN direction = 'BUY' THEN ({a}) - ({b}) > 0 ELSE ({a}) - ({b}) < 0 END, false)"


_ALL3 = "({c} AND {p} AND {f})"


def _each(expr):
    return " AND ".join(expr.format(x=x) for x in ("", "p_", "f_"))


GEOMETRY = f"""least(25, 20 + CASE
  WHEN pattern IN ('HAMMER', 'HANGING_MAN') THEN {_pt('lower >= body * 3', 3)} + {_pt('upper <= range * 0.1', 2)}
  WHEN pattern IN ('INVERTED_HAMMER', 'SHOOTING_STAR') THEN {_pt('upper >= body * 3', 3)} + {_pt('lower <= range * 0.1', 2)}
  WHEN pattern LIKE '%ENGULFING' THEN {_pt('body >= p_body * 1.25', 3)} + {_pt('body >= range * 0.6', 2)}
  WHEN pattern LIKE '%HARAMI' THEN {_pt('enough_2 AND p_body >= median_body_2 * 1.4', 3)} + {_pt('body <= p_body * 0.25', 2)}
  WHEN pattern IN ('PIERCING_LINE', 'DARK_CLOUD_COVER') THEN {_pt('p_body > 0 AND abs(close - p_close) / p_body >= 0.65', 3)} + {_pt('body >= range * 0.6', 2)}
  WHEN pattern = 'MORNING_STAR' THEN {_pt('greatest(p_open, p_close) < least(f_open, f_close)', 2)} + {_pt('body >= f_body * 0.8', 3)}
  WHEN pattern = 'EVENING_STAR' THEN {_pt('least(p_open, p_close) > greatest(f_open, f_close)', 2)} + {_pt('body >= f_body * 0.8', 3)}
  WHEN pattern = 'THREE_WHITE_SOLDIERS' THEN {_pt(_each('{x}body >= {x}range * 0.65'), 3)} + {_pt(_each('{x}upper <= {x}body * 0.15'), 2)}
  WHEN pattern = 'THREE_BLACK_CROWS' THEN {_pt(_each('{x}body >= {x}range * 0.65'), 3)} + {_pt(_each('{x}lower <= {x}body * 0.15'), 2)} ELSE 5 END)"""
TPOINTS = "CASE size WHEN 1 THEN trend_points_1 WHEN 2 THEN trend_points_2 ELSE trend_points_3 END"
QUALITY = f"CAST(floor(({GEOMETRY}) * 10.0 / 25.0 + 0.5) + floor(({TPOINTS}) * 15.0 / 25.0 + 0.5) AS INTEGER)"
_BOTH = "ema_fast IS NOT NULL AND ema_slow IS NOT NULL"
TREND = " + ".join([_pt(f"{_BOTH} AND {_to('ema_fast', 'ema_slow')}", 5), _pt(f"{_BOTH} AND {_to('ema_fast', 'p_ema_fast')}", 3), _pt(f"{_BOTH} AND {_to('ema_slow', 'p_ema_slow')}", 2), _pt(_to("close", "sma_long"), 4), _pt(_to("macd", "macd_signal"), 3), _pt(_to("macd_histogram", "p_macd_histogram"), 3)])
MOMENTUM = f"""CASE WHEN direction = 'BUY' THEN CASE WHEN rsi <= 35 THEN 5 WHEN rsi < 45 THEN 3 WHEN rsi < 50 THEN 1 ELSE 0 END ELSE CASE WHEN rsi >= 65 THEN 5 WHEN rsi > 55 THEN 3 WHEN rsi > 50 THEN 1 ELSE 0 END END
  + {_pt(_to('rsi', 'p_rsi'), 3)} + CASE WHEN direction = 'BUY' THEN CASE WHEN cci <= -100 THEN 4 WHEN cci <= -50 THEN 2 ELSE 0 END ELSE CASE WHEN cci >= 100 THEN 4 WHEN cci >= 50 THEN 2 ELSE 0 END END + {_pt(_to('cci', 'p_cci'), 3)}"""


def _touch(x):
    return f"coalesce(CASE WHEN direction = 'BUY' THEN {x}low <= {x}band_lower * 1.005::DOUBLE ELSE {x}high >= {x}band_upper * 0.995::DOUBLE END, false)"


_TESTED = f"({_touch('')} OR (size >= 2 AND {_touch('p_')}) OR (size >= 3 AND {_touch('f_')}))"
_B = "CASE WHEN band_upper > band_lower THEN (close - band_lower) / (band_upper - band_lower) END"
BANDS = f"""{_pt(_TESTED, 4)} + CASE WHEN direction = 'BUY' THEN CASE WHEN {_B} <= 0.20::DOUBLE THEN 4 WHEN {_B} <= 0.35::DOUBLE THEN 2 ELSE 0 END ELSE CASE WHEN {_B} >= 0.80::DOUBLE THEN 4 WHEN {_B} >= 0.65::DOUBLE THEN 2 ELSE 0 END END
  + {_pt(f"{_TESTED} AND ({_B}) IS NOT NULL AND CASE WHEN direction = 'BUY' THEN close > band_lower ELSE close < band_upper END", 2)}"""
SCALE = "CASE WHEN atr > 0 THEN atr ELSE greatest(abs(close) * 0.01::DOUBLE, 0.000001::DOUBLE) END"
_frame = lambda k: f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {k + 19} PRECEDING AND {k} PRECEDING)"
_near = lambda k: f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
LEVELS = "lv AS (SELECT *, " + ", ".join(f"list(low) OVER {_frame(k)} AS lows_{k}, list(high) OVER {_frame(k)} AS highs_{k}, min(low) OVER {_near(k)} AS min_{k}, max(high) OVER {_near(k)} AS max_{k}" for k in (1, 2, 3)) + " FROM y)"
_size = lambda n: f"CASE size WHEN 1 THEN {n}_1 WHEN 2 THEN {n}_2 ELSE {n}_3 END"
DLEVEL = DETECTED.replace("d AS (", "dl AS (").replace("FROM y WHERE", "FROM lv WHERE")
LEVEL = f"""dz AS (SELECT *, CASE WHEN direction = 'BUY' THEN {_size('lows')} ELSE {_size('highs')} END AS bef, {_size('min')} AS lo, {_size('max')} AS hi, {SCALE} AS sc FROM dl WHERE direction <> 'HOLD'),
dq AS (SELECT *, CASE WHEN direction = 'BUY' THEN list_min(bef) ELSE list_max(bef) END AS lev, greatest(hi - lo, 0.000001::DOUBLE) AS span FROM dz),
dr AS (SELECT *, abs(CASE WHEN direction = 'BUY' THEN lo ELSE hi END - lev) / sc AS off, len(list_filter(bef, lambda q: abs(q - lev) <= sc * 0.5)) AS touches,
  CASE WHEN direction = 'BUY' THEN (close - lo) / span ELSE (hi - close) / span END AS back FROM dq)"""
LEVEL_POINTS = "CASE WHEN bef IS NULL OR len(bef) = 0 THEN 0 ELSE CASE WHEN off <= 0.25 THEN 7 WHEN off <= 0.5 THEN 5 WHEN off <= 1 THEN 3 ELSE 0 END + CASE WHEN touches >= 3 THEN 4 WHEN touches = 2 THEN 2 WHEN touches = 1 THEN 1 ELSE 0 END + CASE WHEN back >= 0.65::DOUBLE THEN 4 WHEN back >= 0.5::DOUBLE THEN 2 ELSE 0 END END"
HIGHER = """hb AS (SELECT symbol, ts, idx, close, date_trunc('month', ts) AS m, lead(date_trunc('month', ts)) OVER (PARTITION BY symbol ORDER BY ts) AS nm FROM x),
hc AS (SELECT s.symbol, s.ts, list(p.close ORDER BY p.ts) AS h FROM hb s JOIN hb p ON p.symbol = s.symbol AND p.idx BETWEEN s.idx - 99 AND s.idx AND p.m < s.m AND p.nm <> p.m GROUP BY s.symbol, s.ts),
hh AS (SELECT symbol, ts, len(h) AS n, least(5, len(h) - 1) AS m, h FROM hc),
hp AS (SELECT symbol, ts, n, h[n] AS last_close, list_sum(h[n - m + 1:n]) / m AS cur, list_sum(h[n - m:n - 1]) / m AS prior FROM hh)"""


def _score(key, name, expression, column=None):
    @query(key, S.over(*PREP, DETECTED, body=f'SELECT symbol, "interval", ts, pattern, direction, CAST({expression} AS INTEGER) AS {name} FROM d WHERE direction <> \'HOLD\''))
    def run(spark, sf_dir):
        df = P.detected(prepared(spark, sf_dir), hold=False).withColumn("geometry", P.score_geometry())
        return df.withColumn("_score", column()).select(*COLUMNS, F.col("_score").cast("int").alias(name))


_score("score_geometry", "points", GEOMETRY, lambda: F.col("geometry"))
_score("score_pattern_quality", "points", QUALITY, P.score_quality)
_score("score_trend", "points", TREND, P.score_trend)
_score("score_momentum", "points", MOMENTUM, P.score_momentum)
_score("score_bollinger", "points", BANDS, P.score_bands)


@query("score_support_resistance", S.over(*PREP, LEVELS, DLEVEL, LEVEL, body=f'SELECT symbol, "interval", ts, pattern, direction, CAST({LEVEL_POINTS} AS INTEGER) AS points FROM dr'))
def score_support_resistance(spark, sf_dir):
    df = P.detected(P.with_levels(prepared(spark, sf_dir)), hold=False)
    return df.select(*COLUMNS, P.score_level().cast("int").alias("points"))


@query("score_higher_timeframe", S.over(*PREP, DETECTED, HIGHER, body=f"""SELECT d.symbol, d."interval", d.ts, pattern, direction, CAST(CASE WHEN coalesce(n, 0) < 4 THEN 0 ELSE {_pt(_to('last_close', 'cur'), 8)} + {_pt(_to('cur', 'prior'), 7)} END AS INTEGER) AS points
FROM d LEFT JOIN hp ON d.symbol = hp.symbol AND d.ts = hp.ts WHERE direction <> 'HOLD'"""))
def score_higher_timeframe(spark, sf_dir):
    df = P.detected(P.with_higher(prepared(spark, sf_dir), "1wk"), hold=False)
    return df.select(*COLUMNS, P.score_higher("1wk").cast("int").alias("points"))


_EDGE = f"abs(close - CASE WHEN direction = 'BUY' THEN value_low ELSE value_high END) / ({SCALE})"
_RATIO = "CASE WHEN average_volume > 0 THEN volume / average_volume END"
VOLUME = f"""CASE WHEN {_RATIO} >= 1.5::DOUBLE THEN 4 WHEN {_RATIO} >= 1.2::DOUBLE THEN 3 WHEN {_RATIO} >= 1 THEN 2 ELSE 0 END + {_pt(_to('close', 'vwap'), 2)} + {_pt(_to('vwap', 'p_vwap'), 1)}
  + {_pt("CASE WHEN direction = 'BUY' THEN close <= poc ELSE close >= poc END", 1)} + CASE WHEN {_EDGE} <= 0.5::DOUBLE THEN 2 WHEN {_EDGE} <= 1 THEN 1 ELSE 0 END"""


@query("score_volume", S.over(*PREP, DETECTED, X.PROFILE, body=f'SELECT symbol, "interval", ts, pattern, direction, CAST({VOLUME} AS INTEGER) AS points FROM d JOIN vp USING (symbol, ts) WHERE direction <> \'HOLD\''))
def score_volume(spark, sf_dir):
    df = P.detected(prepared(spark, sf_dir), hold=False)
    return df.select(*COLUMNS, P.score_volume().cast("int").alias("points"))


_HIGHER_POINTS = f"CASE WHEN coalesce(n, 0) < 4 THEN 0 ELSE {_pt(_to('last_close', 'cur'), 8)} + {_pt(_to('cur', 'prior'), 7)} END"
_TENTHS = " + ".join(f"floor(greatest(0, least({'volume_points' if k == 'volume' else k}, {most})) * {tenth} / {most}.0::DOUBLE + 0.5::DOUBLE)" for k, (tenth, most) in P.FAMILIES.items())
SETUP = f"""sp AS (SELECT dr.*, {QUALITY} AS quality, {TREND} AS trend, {_HIGHER_POINTS} AS higher, {MOMENTUM} AS momentum, {BANDS} AS bands, {LEVEL_POINTS} AS level, {VOLUME} AS volume_points
  FROM dr LEFT JOIN hp USING (symbol, ts) LEFT JOIN vp USING (symbol, ts)),
st AS (SELECT *, CAST(least(100, floor(({_TENTHS}) / 10.0::DOUBLE + 0.5::DOUBLE)) AS INTEGER) AS setup_score FROM sp)"""
SCORED = (*PREP, LEVELS, DLEVEL, LEVEL, HIGHER, X.PROFILE, SETUP)


@query("setup_score", S.over(*SCORED, body="""SELECT symbol, "interval", ts, pattern, direction, quality, trend, higher, momentum, bands, level, volume_points, setup_score, CASE WHEN setup_score < 75 THEN 'LOW' WHEN setup_score < 85 THEN 'MEDIUM' ELSE 'HIGH' END AS strength FROM st"""))
def setup_score(spark, sf_dir):
    return P.scored(prepared(spark, sf_dir), "1wk").select(*COLUMNS, "quality", "trend", "higher", "momentum", "bands", "level", "volume_points", "setup_score", "strength")
