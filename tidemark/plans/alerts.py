"""Queries of what alerts carry, of profile selection and of CSV files, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import alerts as A
from tidemark.operators import backtest as B
from tidemark.operators import indicators as I
from tidemark.operators import patterns as P
from tidemark.operators import profile as V
from tidemark.plans import patterns as Q
from tidemark.plans import signals as SG
from tidemark.plans import sql as S
from tidemark.plans.catalog import query
from tidemark.sources import files
from tidemark.sources import market as M

FWD, MOVE = B.HORIZONS["1wk"]
_ID = 'symbol, "interval", ts, pattern, direction'


def detected(spark, sf_dir):
    return P.detected(P.prepared(M.bars(spark, sf_dir), "1wk"), hold=False)


def signed_sql(change: str) -> str:
    return f"CASE WHEN direction = 'SELL' THEN -({change}) ELSE {change} END"


# ---------------------------------------------------------------- priors and windows

_HELD = ", ".join(f"('{k}', {n}, {d}, {p}::DOUBLE)" for k, (n, d, p) in A.CALIBRATION["1wk"].items())
_POINTS = "CASE WHEN coalesce(decided, 0) < 10 THEN 5 " + " ".join(f"WHEN precision >= {least} THEN {n}" for least, n in A.POINTS) + " ELSE 0 END"


@query("calibration_points", S.over(*Q.PREP, Q.DETECTED, f"held(pattern, sample, decided, precision) AS (VALUES {_HELD})", body=f"SELECT {_ID}, sample, decided, precision, {_POINTS} AS points FROM d LEFT JOIN held USING (pattern) WHERE direction <> 'HOLD'"))
def calibration_points(spark, sf_dir):
    return A.calibration_points(detected(spark, sf_dir)).select(*A.KEYS, "sample", "decided", "precision", "points")


_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.HORIZON_LABELS.items())


@query("horizon_guidance", S.over(S.RULES, body=f"""SELECT rule_id, symbol, "interval", family, CASE WHEN family <> 'ELLIOTT' THEN CASE "interval" {_LABELS} END END AS research_window FROM rules"""))
def horizon_guidance(spark, sf_dir):
    return M.rules(spark, sf_dir).select("rule_id", "symbol", "interval", "family", A.horizon_guidance(F.col("family"), F.col("interval")).alias("research_window"))


# ---------------------------------------------------------------- outcomes

_OUTCOME = f"""fo AS (SELECT symbol, ts, count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND {FWD} FOLLOWING) AS remaining, lead(ts, {FWD}) OVER w AS e_ts, lead(close, {FWD}) OVER w AS e_close,
  max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND {FWD} FOLLOWING) AS mx, min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND {FWD} FOLLOWING) AS mn FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
oo AS (SELECT d.*, fo.* EXCLUDE (symbol, ts), CASE size WHEN 1 THEN high WHEN 2 THEN greatest(high, p_high) ELSE greatest(high, p_high, f_high) END AS ph, CASE size WHEN 1 THEN low WHEN 2 THEN least(low, p_low) ELSE least(low, p_low, f_low) END AS pl,
  {signed_sql("(e_close - close) / close * 100.0::DOUBLE")} AS change FROM d JOIN fo USING (symbol, ts) WHERE direction <> 'HOLD')"""


@query("observed_outcome", S.over(*Q.PREP, Q.DETECTED, _OUTCOME, body=f"""SELECT {_ID}, CASE WHEN remaining < {FWD} THEN 'PENDING' WHEN change >= {MOVE} THEN 'SUCCESS' WHEN change <= -{MOVE} THEN 'FAILURE' ELSE 'INCONCLUSIVE' END AS status,
  CASE WHEN remaining < {FWD} THEN {FWD} - remaining END AS missing, ph AS pattern_high, pl AS pattern_low, e_ts AS evaluation_ts, e_close AS evaluation_close, round(change, 6) + 0.0::DOUBLE AS change,
  round(CASE WHEN remaining >= {FWD} THEN CASE WHEN direction = 'SELL' THEN -((mn - close) / close * 100.0::DOUBLE) ELSE (mx - close) / close * 100.0::DOUBLE END END, 6) + 0.0::DOUBLE AS best_move,
  round(CASE WHEN remaining >= {FWD} THEN CASE WHEN direction = 'SELL' THEN -((mx - close) / close * 100.0::DOUBLE) ELSE (mn - close) / close * 100.0::DOUBLE END END, 6) + 0.0::DOUBLE AS worst_move,
  CASE WHEN remaining >= {FWD} THEN CASE WHEN direction = 'SELL' THEN CASE WHEN change >= 0 THEN 'LOSS_AVOIDED' ELSE 'PRICE_ROSE' END WHEN change >= 0 THEN 'GAIN' ELSE 'LOSS' END END AS impact FROM oo"""))
def observed_outcome(spark, sf_dir):
    events = detected(spark, sf_dir).select(*A.KEYS, "size", F.col("close").alias("price"), F.lit("CANDLESTICK").alias("family"))
    df = A.observed_outcome(events, M.bars(spark, sf_dir), "1wk")
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in ("change", "best_move", "worst_move")})


@query("signal_excursion", S.over(*Q.PREP, Q.DETECTED, SG.INIT, SG.RESOLVE, f"""ev AS (SELECT li.symbol, li."interval", li.ts, li.pattern, li.direction, li.idx, li.close, resolution_offset FROM li JOIN lr USING (symbol, ts, pattern)),
sx AS (SELECT ev.symbol, ev.ts, ev.pattern, max(n.high) AS mx, min(n.low) AS mn, count(*) AS seen FROM ev JOIN b n ON n.symbol = ev.symbol AND n.idx BETWEEN ev.idx + 1 AND ev.idx + coalesce(resolution_offset, 3) GROUP BY ALL)""", body=f"""SELECT {_ID}, coalesce(seen, 0) AS seen, resolution_offset IS NOT NULL AS resolved,
  round(CASE WHEN direction = 'SELL' THEN -((mn - close) / close * 100.0::DOUBLE) ELSE (mx - close) / close * 100.0::DOUBLE END, 6) + 0.0::DOUBLE AS best_move, round(CASE WHEN direction = 'SELL' THEN -((mx - close) / close * 100.0::DOUBLE) ELSE (mn - close) / close * 100.0::DOUBLE END, 6) + 0.0::DOUBLE AS worst_move
FROM ev LEFT JOIN sx USING (symbol, ts, pattern)"""))
def signal_excursion(spark, sf_dir):
    initial, bars = B.lifecycle_init(detected(spark, sf_dir)), I.indexed(M.bars(spark, sf_dir))
    state = B.lifecycle_resolve(initial, bars).select(*A.KEYS, "resolution_offset")
    events = initial.select(*A.KEYS, "idx", F.col("close").alias("price")).join(state, A.KEYS)
    return A.signal_excursion(events, bars).withColumns({c: F.round(c, 6) + 0.0 for c in ("best_move", "worst_move")})


# ---------------------------------------------------------------- profile selection

ANCHOR = "1998-01-01"


def feeds(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Daily, weekly and 15-minute bars; the last from the shipments' line numbers, for equities alone."""
    equity = M.assets(spark, sf_dir).filter("instrument_type = 'EQUITY'").select("symbol")
    finest = M.finest_bars(spark, sf_dir)
    at = F.timestamp_add("MINUTE", (F.col("k2") - 1) * 15, F.col("ts").cast("timestamp"))
    day, week = (M.rolled_up(finest, k, F.date_trunc(M.UNITS[k], "ts")) for k in ("1d", "1wk"))
    return day, week, M.rolled_up(finest.join(equity, "symbol"), V.INTRADAY, at)


def profile_rows(spark, sf_dir, frozen: bool):
    day, week, fine = feeds(spark, sf_dir)
    last = lambda df, want: df.groupBy("symbol").agg(F.max("ts").alias("active")).select("symbol", F.lit(want).alias("want"), F.lit(ANCHOR).cast("timestamp").alias("anchor"), "active")
    anchors, bars = last(day, "1d").union(last(week, "1wk")), day.unionByName(week).unionByName(fine)
    if frozen:
        # the snapshot: half the volume of the open bar; of a day with 15-minute bars, of its first one
        bar = F.struct("interval", "ts", "open", "high", "low", "close", F.expr("volume DIV 2").alias("volume"))
        near = bars.join(anchors, "symbol").filter((F.col("ts") >= F.col("active")) & ((F.col("interval") == F.col("want")) | ((F.col("want") == "1d") & (F.col("interval") == V.INTRADAY))))
        held = near.groupBy("symbol", "want").agg(F.min_by(bar, F.struct(F.col("interval") != V.INTRADAY, "ts")).alias("frozen"))
        anchors = anchors.join(held, ["symbol", "want"], "left")
    return V.selected(bars, anchors)


_FEEDS = (S.TICKS, S.ASSETS, S.bars("1d", "day"), S.bars("1wk", "week"), """fine AS (SELECT symbol, '15min' AS "interval", CAST(ts AS TIMESTAMP) + to_minutes(CAST((k2 - 1) * 15 AS BIGINT)) AS ts, arg_min(price, rn) AS open, max(price) AS high, min(price) AS low, arg_max(price, rn) AS close, CAST(sum(volume) AS BIGINT) AS volume
  FROM ticks WHERE symbol IN (SELECT symbol FROM assets WHERE instrument_type = 'EQUITY') GROUP BY symbol, 3)""", f"""ac AS (SELECT symbol, max(ts) AS active, count(*) FILTER (ts >= TIMESTAMP '{ANCHOR}') AS n, symbol IN (SELECT symbol FROM fine) AS has_fine FROM day GROUP BY symbol),
aw AS (SELECT symbol, max(ts) AS active FROM week GROUP BY symbol)""")  # fmt: skip
_SHOWN = 'ts, open, high, low, close'
_CALC = "CASE WHEN NOT has_fine THEN '1d' WHEN n > 1 THEN '1d+15min' ELSE '15min' END AS calculated"


@query("avp_select", S.over(*_FEEDS, body=f"""SELECT symbol, '1wk' AS want, "interval", {_SHOWN}, volume, '1wk' AS calculated FROM week WHERE ts >= TIMESTAMP '{ANCHOR}'
UNION ALL SELECT symbol, '1d', "interval", {_SHOWN}, volume, {_CALC} FROM day JOIN ac USING (symbol) WHERE ts >= TIMESTAMP '{ANCHOR}' AND (ts < active OR NOT has_fine)
UNION ALL SELECT symbol, '1d', "interval", {_SHOWN}, volume, {_CALC} FROM fine JOIN ac USING (symbol) WHERE ts >= active"""))
def avp_select(spark, sf_dir):
    return profile_rows(spark, sf_dir, False)


@query("avp_freeze", S.over(*_FEEDS, body=f"""SELECT symbol, '1wk' AS want, "interval", {_SHOWN}, CASE WHEN ts = active THEN volume // 2 ELSE volume END AS volume, '1wk' AS calculated FROM week JOIN aw USING (symbol) WHERE ts >= TIMESTAMP '{ANCHOR}'
UNION ALL SELECT symbol, '1d', "interval", {_SHOWN}, CASE WHEN ts = active THEN volume // 2 ELSE volume END, {_CALC} FROM day JOIN ac USING (symbol) WHERE ts >= TIMESTAMP '{ANCHOR}' AND (ts < active OR NOT has_fine)
UNION ALL SELECT symbol, '1d', "interval", {_SHOWN}, volume // 2, {_CALC} FROM (SELECT fine.*, n, has_fine FROM fine JOIN ac ON ac.symbol = fine.symbol AND fine.ts >= active QUALIFY row_number() OVER (PARTITION BY fine.symbol ORDER BY fine.ts) = 1)"""))
def avp_freeze(spark, sf_dir):
    return profile_rows(spark, sf_dir, True)


# ---------------------------------------------------------------- files


@query("load_adjusted_csv", S.over(S.TICKS, S.ASSETS, S.bars("1d", "day"), body="""SELECT symbol, '1d' AS "interval", ts, open, high, low, close, volume FROM day JOIN assets USING (symbol) WHERE instrument_type = 'EQUITY' AND day(ts) <> 13"""))
def load_adjusted_csv(spark, sf_dir):
    """Daily bars through compressed CSV files (each 13th spoilt) and back, equities alone."""
    at = files.shared_folder(spark, "prices")
    low = F.when(F.dayofmonth("ts") == 13, F.col("high") + 1).otherwise(F.col("low"))
    rows = M.bars(spark, sf_dir, "1d").select(F.col("symbol").alias("ticker"), F.col("ts").cast("date").cast("string").alias("date"), "open", "high", low.alias("low"), "close", "volume")
    rows.write.option("header", True).option("compression", "gzip").csv(at)
    universe = M.assets(spark, sf_dir).filter("instrument_type = 'EQUITY'").select("symbol")
    return files.adjusted_csv(spark, at, universe).filter("good").drop("good")


def through_csv(spark, df, order):
    at = files.shared_folder(spark, "rows")
    files.write_rows(df, at, order)
    return files.read_rows(spark, at, df)


_ORDER = ["symbol", "ts", "pattern", "direction"]


@query("write_trades", SG.ora(f"SELECT {_ID}, exit_ts, entry_price, round(close_return, 6) AS close_return, round(best_move, 6) AS best_move, round(worst_move, 6) AS worst_move, outcome FROM tr"))
def write_trades(spark, sf_dir):
    t = SG.weekly_trades(spark, sf_dir).select(*A.KEYS, "exit_ts", "entry_price", *[F.round(c, 6).alias(c) for c in ("close_return", "best_move", "worst_move")], "outcome")
    return through_csv(spark, t, _ORDER)


HORIZONS = (4, 8, 12)


@query("write_signals", S.over(*Q.PREP, Q.DETECTED, "hz AS (SELECT symbol, ts, " + ", ".join(f"lead(close, {n}) OVER w AS c{n}" for n in HORIZONS) + " FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts)), long AS (" + " UNION ALL ".join(f"SELECT symbol, ts, {n} AS horizon, c{n} AS x FROM hz" for n in HORIZONS) + ")", body=f"""SELECT {_ID}, horizon, close AS entry_price, x AS exit_price, round({signed_sql("(x - close) / close * 100.0::DOUBLE")}, 6) + 0.0::DOUBLE AS change FROM d JOIN long USING (symbol, ts) WHERE x IS NOT NULL AND direction <> 'HOLD'"""))
def write_signals(spark, sf_dir):
    p = P.prepared(M.bars(spark, sf_dir), "1wk").withColumns({f"close_{n}": F.lead("close", n).over(I.W()) for n in HORIZONS})
    t = A.signal_horizons(P.detected(p, hold=False), HORIZONS).withColumn("change", F.round("change", 6) + 0.0)
    return through_csv(spark, t, [*_ORDER, "horizon"])
