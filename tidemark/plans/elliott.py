"""Queries of swing pivots and wave counts, on weekly bars. Their SQL builds the
pivots, a sequential fold, as a recursive view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import elliott as L
from tidemark.operators import indicators as I
from tidemark.operators import waves as V
from tidemark.plans import elliott_sql as Q
from tidemark.plans import wave_sql as W
from tidemark.plans.catalog import query
from tidemark.sources import market as M
from tidemark.sources.files import read_rows, shared_folder, write_rows, written


def enriched(spark, sf_dir):
    """Numbered bars with their average true range, written once: pivots and what is joined to them read it."""
    return written(I.with_atr(I.indexed(M.bars(spark, sf_dir)), I.PROFILES["1d"]["atr"]), "bars")


def structures(e):
    """Wave counts of numbered bars, written once."""
    return written(V.structures(V.zigzag_pivots(e), e), "structures")


def counted(spark, sf_dir):
    return structures(enriched(spark, sf_dir))


@query("zigzag_pivots", Q.over(body="""SELECT symbol, '1wk' AS "interval", sensitivity, seq, idx, ts, kind, price FROM pv"""))
def zigzag_pivots(spark, sf_dir):
    return V.zigzag_pivots(enriched(spark, sf_dir))


@query("wave_sequences", Q.over(Q.runs(6), body="SELECT symbol, sensitivity, seq, direction, p[1].ts AS first_ts, p[-1].ts AS last_ts FROM q6"))
def wave_sequences(spark, sf_dir):
    s = V.sequences(zigzag_pivots(spark, sf_dir), 6)
    return s.select("symbol", "sensitivity", "seq", "direction", F.element_at("p", 1)["ts"].alias("first_ts"), F.element_at("p", -1)["ts"].alias("last_ts"))


@query("impulse_rules", Q.over(Q.runs(6), body=f"SELECT symbol, sensitivity, seq, direction FROM q6 WHERE {Q.IMPULSE}"))
def impulse_rules(spark, sf_dir):
    return V.sequences(zigzag_pivots(spark, sf_dir), 6).filter(V.impulse_complete()).select("symbol", "sensitivity", "seq", "direction")


@query("correction_rules", Q.over(Q.runs(9), body=f"SELECT symbol, sensitivity, seq, direction, {Q.VARIANT} AS variant FROM q9 WHERE {Q.CORRECTION}"))
def correction_rules(spark, sf_dir):
    return V.sequences(zigzag_pivots(spark, sf_dir), 9).filter(V.correction_complete()).select("symbol", "sensitivity", "seq", "direction", V.variant().alias("variant"))


@query("structure_quality", Q.over(Q.STRUCTURES, body="""SELECT symbol, "interval", sensitivity, direction, stage, quality, variant, cycle_key, start_idx, end_idx, end_ts, end_price FROM st"""))
def structure_quality(spark, sf_dir):
    return counted(spark, sf_dir).drop("p")


@query("latest_structure", Q.over(Q.STRUCTURES, body=f"""SELECT symbol, "interval", direction, stage, quality, cycle_key, end_ts FROM st WHERE quality >= {V.QUALITY}
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY end_idx DESC, quality DESC, end_idx - start_idx DESC, cycle_key DESC) = 1"""))
def latest_structure(spark, sf_dir):
    return V.latest_structure(counted(spark, sf_dir))


@query("historical_structures", Q.over(Q.STRUCTURES, Q.CHOSEN, body="""SELECT hb.symbol, hb."interval", direction, stage, quality, start_idx, end_idx, end_ts, cycle_key FROM hb JOIN (SELECT symbol, unnest(list_transform(kept, lambda x: x.k)) AS k FROM hg QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY hg.k DESC) = 1) c ON c.symbol = hb.symbol AND c.k = hb.k"""))
def historical_structures(spark, sf_dir):
    return V.historical_structures(counted(spark, sf_dir))


@query("wave_confirmation", Q.over(Q.STRUCTURES, Q.CONFIRMATION, body="SELECT * FROM cf"))
def wave_confirmation(spark, sf_dir):
    e = enriched(spark, sf_dir)
    return V.confirmation(structures(e), e)


@query("elliott_boundaries", Q.over(Q.STRUCTURES, Q.BOUNDARIES, body="SELECT symbol, direction, stage, cycle_key, end_ts, side, trigger, invalidation, high, low FROM bd"))
def elliott_boundaries(spark, sf_dir):
    return V.boundaries(counted(spark, sf_dir)).select("symbol", "direction", "stage", "cycle_key", "end_ts", "side", "trigger", "invalidation", "high", "low")


@query("elliott_lifecycle", Q.over(Q.STRUCTURES, Q.BOUNDARIES, Q.LIFECYCLE, body="""SELECT *, CASE WHEN broken_at <= coalesce(confirmed_at, 10) THEN 'INVALIDATED' WHEN confirmed_at IS NOT NULL THEN 'CONFIRMED'
  WHEN seen >= 10 THEN 'EXPIRED' ELSE 'DETECTED' END AS status FROM lc"""))
def elliott_lifecycle(spark, sf_dir):
    e = enriched(spark, sf_dir)
    return V.lifecycle(V.boundaries(structures(e)), e)


# ------------------------------------------------------------------ signals


def weekly_signals(spark, sf_dir):
    return L.signals(I.enrich(M.bars(spark, sf_dir), "1wk"))


_SIGNAL = ["symbol", "interval", "ts", "pattern", "side", "eligibility", "price"]
_SHOWN = 'symbol, "interval", ts, pattern, side, eligibility, price'


@query("impulse_breakout", W.over(body=f"SELECT {_SHOWN}, idx - turn AS age, third AS level FROM wl WHERE kind = 'IMPULSE'"))
def impulse_breakout(spark, sf_dir):
    return weekly_signals(spark, sf_dir).filter("kind = 'IMPULSE'").select(*_SIGNAL, (F.col("idx") - F.col("turn")).alias("age"), F.col("third").alias("level"))


@query("wave_v_end", W.over(body=f"SELECT {_SHOWN}, idx - turn AS age, end_idx, end_price FROM wl WHERE kind = 'V'"))
def wave_v_end(spark, sf_dir):
    return weekly_signals(spark, sf_dir).filter("kind = 'V'").select(*_SIGNAL, (F.col("idx") - F.col("turn")).alias("age"), "end_idx", "end_price")


@query("correction_end", W.over(body=f"SELECT {_SHOWN}, idx - turn AS age, end_idx, end_price FROM wl WHERE kind = 'C'"))
def correction_end(spark, sf_dir):
    return weekly_signals(spark, sf_dir).filter("kind = 'C'").select(*_SIGNAL, (F.col("idx") - F.col("turn")).alias("age"), "end_idx", "end_price")


@query("elliott_v1_score", W.over(body=f"SELECT {_SHOWN} FROM wl"))
def elliott_v1_score(spark, sf_dir):
    return weekly_signals(spark, sf_dir).select(*_SIGNAL)


@query("elliott_v2_score", W.over(body="SELECT * EXCLUDE (third, kind) FROM wl"))
def elliott_v2_score(spark, sf_dir):
    return weekly_signals(spark, sf_dir).drop("third", "sensitivity", "kind")


@query("elliott_alerts", W.over(body=f"SELECT {_SHOWN}, score, strength FROM wl WHERE eligibility >= {L.ALERT} AND kind IN ('V', 'C')"))
def elliott_alerts(spark, sf_dir):
    return L.alerts(weekly_signals(spark, sf_dir)).select(*_SIGNAL, "score", "strength")


_WINDOWS = L.OUTCOMES["1wk"]
_MOVES = ("close_return", "best_move", "worst_move")
OUTCOMES = f"""wo AS (SELECT *, CASE WHEN close_return >= move THEN 'SUCCESS' WHEN close_return <= -move THEN 'FAILURE' ELSE 'INCONCLUSIVE' END AS outcome FROM (
  SELECT symbol, "interval", ts, pattern, side, score, entry_price, horizon, move, exit_ts, CASE WHEN side = 'BUY' THEN x ELSE -x END AS close_return, CASE WHEN side = 'BUY' THEN hi ELSE -lo END AS best_move, CASE WHEN side = 'BUY' THEN lo ELSE -hi END AS worst_move FROM (
    SELECT s.symbol, s."interval", s.ts, pattern, side, score, s.price AS entry_price, horizon, move, e.ts AS exit_ts, (e.close - s.price) / s.price * 100.0::DOUBLE AS x,
      ((SELECT max(f.high) FROM b f WHERE f.symbol = s.symbol AND f.idx BETWEEN s.idx + 1 AND s.idx + horizon) - s.price) / s.price * 100.0::DOUBLE AS hi,
      ((SELECT min(f.low) FROM b f WHERE f.symbol = s.symbol AND f.idx BETWEEN s.idx + 1 AND s.idx + horizon) - s.price) / s.price * 100.0::DOUBLE AS lo
    FROM wl s CROSS JOIN (VALUES {', '.join(f'({n}, {m}::DOUBLE)' for n, m in _WINDOWS)}) h(horizon, move) JOIN b e ON e.symbol = s.symbol AND e.idx = s.idx + horizon JOIN b z ON z.symbol = s.symbol AND z.idx = s.idx + {max(n for n, _ in _WINDOWS)}
    WHERE s.idx >= {L.WINDOW} AND eligibility >= {L.ALERT} AND kind IN ('V', 'C'))))"""


def weekly_outcomes(spark, sf_dir):
    """Weekly wave alerts and what followed; the bars are written once for both."""
    e = written(I.enrich(M.bars(spark, sf_dir), "1wk"), "enriched")
    return L.outcomes(L.alerts(L.signals(e)), e, _WINDOWS)


@query("write_wave_signals", W.over(OUTCOMES, body="SELECT symbol, \"interval\", ts, pattern, side, score, entry_price, horizon, move, exit_ts, " + ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in _MOVES) + ", outcome FROM wo"))
def write_wave_signals(spark, sf_dir):
    """Wave alerts by horizon through CSV files and back."""
    rows = weekly_outcomes(spark, sf_dir).withColumns({c: F.round(c, 6) + 0.0 for c in _MOVES})
    at = shared_folder(spark, "rows")
    write_rows(rows, at, ["interval", "symbol", "ts", "pattern", "horizon"])
    return read_rows(spark, at, rows)


@query("wave_score_stats", W.over(OUTCOMES, body=f"""SELECT "interval", horizon, move, least, stage, count(*) AS signals, count(*) FILTER (outcome = 'SUCCESS') AS successes, count(*) FILTER (outcome = 'FAILURE') AS failures, count(*) FILTER (outcome = 'INCONCLUSIVE') AS inconclusive,
  round(CASE WHEN count(*) FILTER (outcome <> 'INCONCLUSIVE') > 0 THEN count(*) FILTER (outcome = 'SUCCESS') * 100.0::DOUBLE / count(*) FILTER (outcome <> 'INCONCLUSIVE') END, 6) AS precision, {', '.join(f'round(avg({c}), 6) AS average_{c}' for c in _MOVES)}
FROM (SELECT *, unnest(['ALL', CASE WHEN ends_with(pattern, 'CORRECTION') THEN 'C' ELSE 'V' END]) AS stage FROM wo) JOIN (SELECT unnest({list(L.SCORES)}) AS least) ON score >= least GROUP BY ALL"""))
def wave_score_stats(spark, sf_dir):
    return L.outcome_stats(weekly_outcomes(spark, sf_dir))


# --------------------------------------------------------------- structures


@query("quality_warnings", Q.over(Q.STRUCTURES, body=f"""SELECT symbol, sensitivity, stage, cycle_key, end_ts, array_to_string({Q.WARNINGS}, '; ') AS warnings FROM st"""))
def quality_warnings(spark, sf_dir):
    return V.measured(V.pointed(counted(spark, sf_dir))).select("symbol", "sensitivity", "stage", "cycle_key", "end_ts", F.array_join(V.warnings(), "; ").alias("warnings"))


@query("correction_variant", Q.over(Q.STRUCTURES, body="SELECT symbol, sensitivity, cycle_key, stage, end_ts, variant FROM st"))
def correction_variant(spark, sf_dir):
    return counted(spark, sf_dir).select("symbol", "sensitivity", "cycle_key", "stage", "end_ts", "variant")


@query("cycle_key", Q.over(Q.STRUCTURES, body="SELECT symbol, cycle_key, count(*) AS structures, count(*) FILTER (stage = 'C') AS corrections, max(end_ts) AS end_ts FROM st GROUP BY ALL"))
def cycle_key(spark, sf_dir):
    return counted(spark, sf_dir).groupBy("symbol", "cycle_key").agg(F.count("*").alias("structures"), F.count_if(F.col("stage") == "C").alias("corrections"), F.max("end_ts").alias("end_ts"))


def with_confirmation(spark, sf_dir):
    e = enriched(spark, sf_dir)
    return V.confirmed(structures(e), e)


@query("structure_for_signal", Q.over(Q.STRUCTURES, Q.CONFIRMATION, Q.CONFIRMED, body="""SELECT a.symbol, a."interval", a.direction, a.stage, a.variant, a.at AS ts, c.cycle_key, c.quality, c.end_ts, c.confirm_ts
FROM (SELECT DISTINCT symbol, "interval", direction, stage, variant, confirm_ts + INTERVAL 30 DAY AS at FROM cs) a
JOIN cs c ON c.symbol = a.symbol AND c.direction = a.direction AND c.stage = a.stage AND c.variant = a.variant AND c.confirm_ts <= a.at
QUALIFY row_number() OVER (PARTITION BY a.symbol, a.direction, a.stage, a.variant, a.at ORDER BY c.confirm_ts DESC, c.quality DESC, c.end_idx - c.start_idx DESC, c.cycle_key DESC) = 1"""))
def structure_for_signal(spark, sf_dir):
    """Signals: every kind of structure, asked for 30 days after each of its confirmations."""
    s = with_confirmation(spark, sf_dir)
    asks = s.select("symbol", "interval", "direction", "stage", "variant", (F.col("confirm_ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).distinct()
    return V.structure_for_signal(s, asks)


@query("structure_for_cycle", Q.over(Q.STRUCTURES, Q.CONFIRMATION, Q.CONFIRMED, body=f"""SELECT symbol, "interval", cycle_key, stage, end_ts, confirm_ts, quality, end_price FROM cs WHERE quality >= {V.QUALITY}
QUALIFY row_number() OVER (PARTITION BY symbol, cycle_key, stage ORDER BY end_ts DESC, confirm_ts DESC, quality DESC, end_price DESC) = 1"""))
def structure_for_cycle(spark, sf_dir):
    s = with_confirmation(spark, sf_dir)
    return V.structure_for_cycle(s, s.select("symbol", "interval", "cycle_key", "stage").distinct())


@query("elliott_revise", Q.over(Q.STRUCTURES, Q.BOUNDARIES, body="""SELECT symbol, "interval", cycle_key, stage, count(DISTINCT end_idx) AS endpoints, max(end_idx) > min(end_idx) AS revised, min(end_ts) AS anchor_ts, max(end_ts) AS end_ts,
  arg_max(end_price, {'e': end_idx, 'q': CASE WHEN lo < hi THEN quality ELSE -quality END}) AS end_price, arg_max(trigger, {'e': end_idx, 'q': CASE WHEN lo < hi THEN quality ELSE -quality END}) AS trigger,
  arg_max({'v': invalidation}, {'e': end_idx, 'q': CASE WHEN lo < hi THEN quality ELSE -quality END}).v AS invalidation, arg_max(high, {'e': end_idx, 'q': CASE WHEN lo < hi THEN quality ELSE -quality END}) AS high, arg_max(low, {'e': end_idx, 'q': CASE WHEN lo < hi THEN quality ELSE -quality END}) AS low
FROM (SELECT *, min(end_idx) OVER c AS lo, max(end_idx) OVER c AS hi FROM bd WINDOW c AS (PARTITION BY symbol, cycle_key, stage)) GROUP BY symbol, "interval", cycle_key, stage"""))
def elliott_revise(spark, sf_dir):
    return V.revised(V.boundaries(counted(spark, sf_dir)))


@query("stage_stats", Q.over(Q.STRUCTURES, Q.CONFIRMATION, Q.CONFIRMED, Q.STAGES, body="SELECT * FROM stages"))
def stage_stats(spark, sf_dir):
    """Confirmed wave ends by horizon, least quality and stage: what followed the confirmation."""
    e = enriched(spark, sf_dir)
    return V.stage_stats(V.confirmed(structures(e), e), e)
