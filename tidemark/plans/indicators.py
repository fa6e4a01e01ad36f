"""Queries of the indicators, on weekly bars, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import indicators as I
from tidemark.plans import sql as S
from tidemark.plans.catalog import query
from tidemark.sources import market as M

P = I.PROFILES["1wk"]
WIN = 'WINDOW w AS (PARTITION BY symbol ORDER BY ts)'
KEYS = 'symbol, "interval", ts'


def frame(n: int) -> str:
    return f"(w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


IDX = f"b AS (SELECT *, row_number() OVER w AS idx FROM bars {WIN})"
# What averages are taken of, and all of them as one recursion, bar after bar.
STEPS = f"""rsteps AS MATERIALIZED (SELECT symbol, idx, close, greatest(mv, 0) AS gain, greatest(-mv, 0) AS loss, tr FROM (
  SELECT *, coalesce(close - p, 0) AS mv, coalesce(CASE WHEN p IS NULL THEN NULL ELSE greatest(high - low, abs(high - p), abs(low - p)) END, high - low) AS tr
  FROM (SELECT *, lag(close) OVER w AS p FROM b {WIN})))"""


def moved(now: str, alpha: str, x: str) -> str:
    return f"({now} + CAST({alpha} AS DOUBLE) * ({x} - {now}))"


def recursion(name: str, p: dict) -> str:
    """ef, es, mf, ms, sg, ga, la, tra: the averages of a profile's periods at each bar."""
    fast, slow, signal = p["macd"]
    k = lambda n: f"(CAST(2.0 AS DOUBLE) / {n + 1})"
    w = lambda n: f"(CAST(1.0 AS DOUBLE) / {n})"
    mf, ms = moved("r.mf", k(fast), "q.close"), moved("r.ms", k(slow), "q.close")
    return f"""{name} AS (SELECT symbol, idx, close AS ef, close AS es, close AS mf, close AS ms, 0.0::DOUBLE AS sg, gain AS ga, loss AS la, tr AS tra FROM rsteps WHERE idx = 1 UNION ALL
  SELECT q.symbol, q.idx, {moved('r.ef', k(p['fast']), 'q.close')}, {moved('r.es', k(p['slow']), 'q.close')}, {mf}, {ms}, {moved('r.sg', k(signal), f'({mf} - {ms})')},
    {moved('r.ga', w(p['rsi']), 'q.gain')}, {moved('r.la', w(p['rsi']), 'q.loss')}, {moved('r.tra', w(p['atr']), 'q.tr')}
  FROM {name} r JOIN rsteps q ON q.symbol = r.symbol AND q.idx = r.idx + 1)"""


def shown(df, *cols):
    return df.select("symbol", "interval", "ts", *[F.round(c, 6).alias(c) for c in cols])


def rounded(*cols: str) -> str:
    return f"SELECT {KEYS}, " + ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def weekly(spark, sf_dir):
    return I.indexed(M.bars(spark, sf_dir))


SMA = f"s AS (SELECT *, CASE WHEN idx >= {P['sma']} THEN avg(close) OVER {frame(P['sma'])} END AS sma_long, CASE WHEN idx >= {P['volume']} THEN avg(volume) OVER {frame(P['volume'])} END AS average_volume FROM b {WIN})"
EMA = f"e AS (SELECT b.*, CASE WHEN idx >= {P['fast']} THEN ef END AS ema_fast, CASE WHEN idx >= {P['slow']} THEN es END AS ema_slow FROM b JOIN ravg USING (symbol, idx))"
RSI = f"""r AS (SELECT b.*, CASE WHEN idx >= {P['rsi'] + 1} THEN CASE WHEN la = 0 THEN CASE WHEN ga = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END ELSE 100.0::DOUBLE - 100.0::DOUBLE / (1.0::DOUBLE + ga / la) END END AS rsi
  FROM b JOIN ravg USING (symbol, idx))"""
F_, S_, G_ = P["macd"]
MACD = f"""m AS (SELECT b.*, CASE WHEN idx >= {S_} THEN mf - ms END AS macd, CASE WHEN idx >= {S_ + G_ - 1} THEN sg END AS macd_signal, CASE WHEN idx >= {S_ + G_ - 1} THEN mf - ms - sg END AS macd_histogram FROM b JOIN ravg USING (symbol, idx))"""
CCI = f"""c AS (SELECT *, CASE WHEN idx >= {P['cci']} THEN CASE WHEN off = 0 THEN 0.0::DOUBLE ELSE (tp - mean) / (0.015::DOUBLE * off) END END AS cci FROM (
  SELECT *, list_sum(list_transform(tps, lambda x: abs(x - mean))) / {P['cci']} AS off FROM (
  SELECT *, list(tp) OVER {frame(P['cci'])} AS tps, avg(tp) OVER {frame(P['cci'])} AS mean FROM (SELECT *, (high + low + close) / 3.0::DOUBLE AS tp FROM b) {WIN})))"""
ATR = f"a AS (SELECT b.*, CASE WHEN idx >= {P['atr'] + 1} THEN tra END AS atr FROM b JOIN ravg USING (symbol, idx))"
BANDS = f"""bb AS (SELECT *, CASE WHEN idx >= {P['band']} THEN md END AS band_middle, CASE WHEN idx >= {P['band']} THEN md + 2 * sd END AS band_upper, CASE WHEN idx >= {P['band']} THEN md - 2 * sd END AS band_lower FROM (
  SELECT *, avg(close) OVER {frame(P['band'])} AS md, stddev_pop(close) OVER {frame(P['band'])} AS sd FROM b {WIN}))"""
VWAP = f"""v AS (SELECT *, CASE WHEN idx >= {P['vwap']} AND sum(volume) OVER {frame(P['vwap'])} > 0 THEN sum((high + low + close) / 3.0::DOUBLE * volume) OVER {frame(P['vwap'])} / sum(volume) OVER {frame(P['vwap'])} END AS vwap FROM b {WIN})"""
BASE = (S.TICKS, S.bars(), IDX, STEPS, recursion("ravg", P))


def ora(view: str, *cols: str) -> str:
    return S.over(*BASE, view, body=rounded(*cols) + " FROM " + view.split(" ")[0])


@query("ind_sma", ora(SMA, "sma_long", "average_volume"))
def ind_sma(spark, sf_dir):
    df = weekly(spark, sf_dir).withColumns({"sma_long": I.sma(F.col("close"), P["sma"]), "average_volume": I.sma(F.col("volume"), P["volume"])})
    return shown(df, "sma_long", "average_volume")


@query("ind_ema", ora(EMA, "ema_fast", "ema_slow"))
def ind_ema(spark, sf_dir):
    return shown(I.with_emas(weekly(spark, sf_dir), ema_fast=P["fast"], ema_slow=P["slow"]), "ema_fast", "ema_slow")


@query("ind_rsi", ora(RSI, "rsi"))
def ind_rsi(spark, sf_dir):
    return shown(I.with_rsi(weekly(spark, sf_dir), P["rsi"]), "rsi")


@query("ind_macd", ora(MACD, "macd", "macd_signal", "macd_histogram"))
def ind_macd(spark, sf_dir):
    return shown(I.with_macd(weekly(spark, sf_dir), *P["macd"]), "macd", "macd_signal", "macd_histogram")


@query("ind_cci", ora(CCI, "cci"))
def ind_cci(spark, sf_dir):
    return shown(I.with_cci(weekly(spark, sf_dir), P["cci"]), "cci")


@query("ind_atr", ora(ATR, "atr"))
def ind_atr(spark, sf_dir):
    return shown(I.with_atr(weekly(spark, sf_dir), P["atr"]), "atr")


@query("ind_bollinger", ora(BANDS, "band_middle", "band_upper", "band_lower"))
def ind_bollinger(spark, sf_dir):
    return shown(I.with_bands(weekly(spark, sf_dir), P["band"]), "band_middle", "band_upper", "band_lower")


@query("ind_vwap", ora(VWAP, "vwap"))
def ind_vwap(spark, sf_dir):
    return shown(weekly(spark, sf_dir).withColumn("vwap", I.vwap(P["vwap"])), "vwap")


_BIN = lambda p: f"greatest(0, least({I.PROFILE_BINS - 1}, CAST(floor((q.{p} - lo) / w) AS INTEGER)))"
_LAST = I.PROFILE_BINS - 1
PROFILE = f"""vp0 AS (SELECT symbol, ts, idx, list(struct_pack(low := low, high := high, v := CAST(greatest(volume, 0) AS DOUBLE))) OVER u AS held, min(low) OVER u AS lo, max(high) OVER u AS hi, sum(CAST(greatest(volume, 0) AS DOUBLE)) OVER u AS total, (max(high) OVER u - min(low) OVER u) / {I.PROFILE_BINS}.0::DOUBLE AS w
  FROM b WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {P['profile'] - 1} PRECEDING AND CURRENT ROW)),
vp1 AS (SELECT *, list_transform(held, lambda q: struct_pack(a := {_BIN('low')}, z := {_BIN('high')}, v := q.v)) AS spans FROM vp0 WHERE w > 0),
vp2 AS (SELECT *, list_transform(range(0, {I.PROFILE_BINS}), lambda k: list_reduce(list_transform(spans, lambda q: CASE WHEN q.a <= k AND q.z >= k THEN q.v / (q.z - q.a + 1) ELSE 0.0::DOUBLE END), lambda s, q: s + q)) AS vol FROM vp1),
vp3 AS (SELECT *, CAST(list_position(vol, list_max(vol)) - 1 AS INTEGER) AS top FROM vp2),
vg AS (SELECT symbol, ts, top AS l, top AS h, vol[top + 1] AS v, vol, total FROM vp3 UNION ALL
  SELECT symbol, ts, CASE WHEN above > below THEN l ELSE l - 1 END, CASE WHEN above > below THEN h + 1 ELSE h END, v + greatest(above, below), vol, total
  FROM (SELECT *, CASE WHEN l > 0 THEN vol[l] ELSE -1 END AS below, CASE WHEN h < {_LAST} THEN vol[h + 2] ELSE -1 END AS above FROM vg WHERE v < total * {I.VALUE_AREA}::DOUBLE AND (l > 0 OR h < {_LAST}))),
ve AS (SELECT symbol, ts, min(l) AS l, max(h) AS h FROM vg GROUP BY symbol, ts),
vp AS (SELECT vp0.symbol, vp0.ts, CASE WHEN enough THEN CASE WHEN vp0.w = 0 THEN vp0.lo ELSE vp0.lo + (top + 0.5::DOUBLE) * vp0.w END END AS poc, CASE WHEN enough THEN CASE WHEN vp0.w = 0 THEN vp0.lo ELSE vp0.lo + l * vp0.w END END AS value_low, CASE WHEN enough THEN CASE WHEN vp0.w = 0 THEN vp0.hi ELSE vp0.lo + (h + 1.0::DOUBLE) * vp0.w END END AS value_high
  FROM (SELECT *, idx >= {P['profile']} AND total > 0 AS enough FROM vp0) vp0 LEFT JOIN vp3 USING (symbol, ts) LEFT JOIN ve USING (symbol, ts))"""


@query("ind_volume_profile", S.over(*BASE, PROFILE, body=f'SELECT b.symbol, b."interval", b.ts, round(poc, 6) AS poc, round(value_low, 6) AS value_low, round(value_high, 6) AS value_high FROM b JOIN vp USING (symbol, ts)'))
def ind_volume_profile(spark, sf_dir):
    return shown(I.with_volume_profile(weekly(spark, sf_dir), P["profile"]), "poc", "value_low", "value_high")


_ALL = ["ema_fast", "ema_slow", "sma_long", "average_volume", "rsi", "macd", "macd_signal", "macd_histogram", "cci", "atr", "band_middle", "band_upper", "band_lower", "vwap"]
ENRICHED = (EMA, SMA, RSI, MACD, CCI, ATR, BANDS, VWAP, """x AS (SELECT b.*, ema_fast, ema_slow, sma_long, average_volume, rsi, macd, macd_signal, macd_histogram, cci, atr, band_middle, band_upper, band_lower, vwap
  FROM b JOIN e USING (symbol, ts) JOIN s USING (symbol, ts) JOIN r USING (symbol, ts) JOIN m USING (symbol, ts) JOIN c USING (symbol, ts) JOIN a USING (symbol, ts) JOIN bb USING (symbol, ts) JOIN v USING (symbol, ts))""")


@query("enrich_bars", S.over(*BASE, *ENRICHED, body=rounded(*_ALL) + " FROM x QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100"))
def enrich_bars(spark, sf_dir):
    return shown(I.enrich(M.bars(spark, sf_dir), "1wk", latest=100), *_ALL)


@query("required_history", S.over(S.TICKS, S.bars(), body="""SELECT symbol, "interval", count(*) AS held, 139 AS required, count(*) >= 139 AS enough FROM bars GROUP BY ALL"""))
def required_history(spark, sf_dir):
    need = I.required_history(100)["1wk"]
    return M.bars(spark, sf_dir).groupBy("symbol", "interval").agg(F.count("*").alias("held")).select("symbol", "interval", "held", F.lit(need).alias("required"), (F.col("held") >= need).alias("enough"))


ANATOMY = f"""n AS (SELECT *, abs(close - open) AS body, greatest(high - low, 0.000001::DOUBLE) AS range, greatest(0.0::DOUBLE, high - greatest(open, close)) AS upper,
  greatest(0.0::DOUBLE, least(open, close) - low) AS lower, close > open AS bull, close < open AS bear FROM b)"""


@query("bar_anatomy", S.over(*BASE, ANATOMY, body=rounded("body", "range", "upper", "lower") + ", bull, bear FROM n"))
def bar_anatomy(spark, sf_dir):
    df = I.anatomy(weekly(spark, sf_dir))
    return df.select("symbol", "interval", "ts", *[F.round(c, 6).alias(c) for c in ("body", "range", "upper", "lower")], "bull", "bear")


def baseline_sql(k: int, source: str = "n") -> str:
    f = f"(w ROWS BETWEEN {k + 19} PRECEDING AND {k} PRECEDING)"
    return f"""k{k} AS (SELECT *, mb >0 AND mr > 0 AND cnt >= 3 AS enough_{k}, coalesce(mb, 0) AS median_body_{k}, coalesce(mr, 0) AS median_range_{k} FROM (
  SELECT symbol, ts, median(body) OVER {f} AS mb, median(range) OVER {f} AS mr, count(body) OVER {f} AS cnt FROM {source} {WIN}))"""


@query("body_baseline", S.over(*BASE, ANATOMY, baseline_sql(2), body=f"SELECT symbol, '1wk' AS \"interval\", ts, round(median_body_2, 6) AS median_body, round(median_range_2, 6) AS median_range, coalesce(enough_2, false) AS enough FROM k2"))
def body_baseline(spark, sf_dir):
    df = I.body_baseline(I.anatomy(weekly(spark, sf_dir)), 2)
    return df.select("symbol", "interval", "ts", F.round("median_body_2", 6).alias("median_body"), F.round("median_range_2", 6).alias("median_range"), F.col("enough_2").alias("enough"))


def _points(closes, structure, aligned):
    return f"""least(25, 14 + CASE WHEN {structure}::DOUBLE / n >= 0.75 THEN 4 WHEN {structure}::DOUBLE / n >= 0.5 THEN 2 ELSE 0 END + CASE WHEN {closes}::DOUBLE / n >= 0.75 THEN 3 WHEN {closes}::DOUBLE / n >= 0.5 THEN 1 ELSE 0 END
    + CASE WHEN abs(net) / lst >= 2.0 THEN 3 WHEN abs(net) / lst >= 1.5 THEN 2 ELSE 1 END + CASE WHEN {aligned} THEN 1 ELSE 0 END)"""


_F5, _F4 = "(w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", "(w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
TREND = f"""t AS (SELECT *, CASE WHEN cnt < 3 THEN 'NONE' WHEN is_up THEN 'UP' WHEN is_down THEN 'DOWN' WHEN is_base THEN 'BASE' ELSE 'NONE' END AS t_dir,
  CASE WHEN cnt < 3 THEN 0 WHEN is_up THEN {_points('u', 'hh', 'ema_up')} WHEN is_down THEN {_points('d', 'll', 'ema_dn')} WHEN is_base THEN 15 ELSE 0 END AS t_points FROM (
  SELECT *, net >= lst AND (hh >= ceil(n * 0.6) OR (u >= ceil(n * 0.6) AND path >= 0.35)) AS is_up, -net >= lst AND (ll >= ceil(n * 0.6) OR (d >= ceil(n * 0.6) AND path >= 0.35)) AS is_down,
    abs(net) < lst AND u > 0 AND d > 0 AND top - bottom <= greatest(abs(frst) * 0.04::DOUBLE, 0.000001::DOUBLE) AS is_base FROM (
  SELECT *, cnt - 1 AS n, close - frst AS net, greatest(abs(frst) * 0.015::DOUBLE, 0.000001::DOUBLE) AS lst, CASE WHEN mv > 0 THEN abs(close - frst) / mv ELSE 0.0 END AS path FROM (
  SELECT *, coalesce(sum(CASE WHEN close > pc THEN 1 ELSE 0 END) OVER {_F4}, 0) AS u, coalesce(sum(CASE WHEN close < pc THEN 1 ELSE 0 END) OVER {_F4}, 0) AS d,
    coalesce(sum(CASE WHEN high > ph AND low > pl THEN 1 ELSE 0 END) OVER {_F4}, 0) AS hh, coalesce(sum(CASE WHEN high < ph AND low < pl THEN 1 ELSE 0 END) OVER {_F4}, 0) AS ll,
    coalesce(sum(abs(close - pc)) OVER {_F4}, 0) AS mv, count(close) OVER {_F5} AS cnt, first_value(close) OVER {_F5} AS frst, max(high) OVER {_F5} AS top, min(low) OVER {_F5} AS bottom,
    CASE WHEN ema_fast IS NULL THEN false WHEN NOT (close > ema_fast) OR pe IS NULL THEN close > ema_fast ELSE ema_fast > pe END AS ema_up,
    CASE WHEN ema_fast IS NULL THEN false WHEN NOT (close < ema_fast) OR pe IS NULL THEN close < ema_fast ELSE ema_fast < pe END AS ema_dn FROM (
  SELECT *, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(ema_fast) OVER w AS pe FROM e {WIN}) {WIN}))))"""


def prior_sql(k: int) -> str:
    return f"p{k} AS (SELECT symbol, ts, coalesce(lag(t_dir, {k}) OVER w, 'NONE') AS trend_{k}, coalesce(lag(t_points, {k}) OVER w, 0) AS trend_points_{k} FROM t {WIN})"


@query("prior_trend", S.over(*BASE, EMA, TREND, prior_sql(2), body="SELECT symbol, '1wk' AS \"interval\", ts, trend_2 AS trend, CAST(trend_points_2 AS INTEGER) AS points FROM p2"))
def prior_trend(spark, sf_dir):
    df = I.prior_trend(I.trend_at(I.with_emas(weekly(spark, sf_dir), ema_fast=P["fast"])), 2)
    return df.select("symbol", "interval", "ts", F.col("trend_2").alias("trend"), F.col("trend_points_2").cast("int").alias("points"))


@query("ema_alignment", S.over(*BASE, EMA, TREND, body="SELECT symbol, '1wk' AS \"interval\", ts, ema_up, ema_dn FROM t"))
def ema_alignment(spark, sf_dir):
    df = I.trend_at(I.with_emas(weekly(spark, sf_dir), ema_fast=P["fast"]))
    return df.select("symbol", "interval", "ts", F.col("_emaup").alias("ema_up"), F.col("_emadn").alias("ema_dn"))
