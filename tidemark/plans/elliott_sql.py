"""SQL of the wave queries. The pivots, a sequential fold, are a recursive view over the
bars' numbers; what follows are windows, filters and joins on them."""

from __future__ import annotations

from tidemark.operators import waves as V
from tidemark.plans import indicators as PI
from tidemark.plans import sql as S

_N = 14  # bars of the average true range
ATR = f"""ra AS (SELECT symbol, idx, tr AS tra FROM rsteps WHERE idx = 1 UNION ALL SELECT q.symbol, q.idx, {PI.moved('ra.tra', f'(CAST(1.0 AS DOUBLE) / {_N})', 'q.tr')} FROM ra JOIN rsteps q ON q.symbol = ra.symbol AND q.idx = ra.idx + 1),
a AS (SELECT b.*, rsteps.tr, CASE WHEN b.idx >= {_N + 1} THEN tra END AS atr FROM b JOIN rsteps USING (symbol, idx) JOIN ra USING (symbol, idx))"""
REACH = f"""u AS (SELECT *, CASE WHEN atr > 0 THEN atr ELSE greatest(tr, 0.000001::DOUBLE) END AS used FROM a),
vol AS (SELECT *, CASE WHEN atr > 0 THEN atr ELSE avg(used) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END AS volatility FROM u {PI.WIN}),
z AS (SELECT symbol, CAST(s AS DOUBLE) AS s, idx, ts, high, low, close, greatest(volatility * s, abs(close) * 0.0125::DOUBLE * s) AS reach
  FROM vol, (SELECT unnest({list(V.SENSITIVITIES)}::DOUBLE[]) AS s))"""
# side 0 until the first turn; then `best` is the extreme of the running leg
FOLD = """zz AS (
SELECT symbol, s, idx AS i, 0 AS side, idx AS top, high AS top_h, reach AS top_r, idx AS bottom, low AS bottom_l, reach AS bottom_r,
  idx AS best, high AS best_v, reach AS best_r, []::STRUCT(b BIGINT, g INTEGER, p DOUBLE)[] AS pts FROM z WHERE idx = 1
UNION ALL
SELECT symbol, s, i, CASE WHEN side = 0 AND begins THEN first_side WHEN side <> 0 AND turns THEN -side ELSE side END, top, top_h, top_r, bottom, bottom_l, bottom_r,
  CASE WHEN side = 0 THEN CASE WHEN first_side = 1 THEN top ELSE bottom END WHEN turns THEN i ELSE best END,
  CASE WHEN side = 0 THEN CASE WHEN first_side = 1 THEN top_h ELSE bottom_l END WHEN turns THEN CASE WHEN side = 1 THEN low ELSE high END ELSE best_v END,
  CASE WHEN side = 0 THEN CASE WHEN first_side = 1 THEN top_r ELSE bottom_r END WHEN turns THEN reach ELSE best_r END,
  CASE WHEN side = 0 THEN CASE WHEN begins THEN [CASE WHEN first_side = 1 THEN {'b': bottom, 'g': -1, 'p': bottom_l} ELSE {'b': top, 'g': 1, 'p': top_h} END] ELSE pts END
    WHEN NOT turns THEN pts
    WHEN pts[-1].g = side THEN CASE WHEN (best_v - pts[-1].p) * side > 0 THEN list_append(pts[:-2], {'b': best, 'g': side, 'p': best_v}) ELSE pts END
    WHEN pts[-1].b <> best THEN list_append(pts, {'b': best, 'g': side, 'p': best_v}) ELSE pts END
FROM (
  SELECT *, top_h - bottom_l >= greatest(top_r, bottom_r) AS begins, CASE WHEN bottom < top OR (bottom = top AND close >= (high + low) / 2) THEN 1 ELSE -1 END AS first_side,
    (best_v - CASE WHEN side = 1 THEN low ELSE high END) * side >= best_r AND (best < i OR (close - (high + low) / 2) * side <= 0) AS turns
  FROM (
    SELECT k.symbol, k.s, z.idx AS i, k.side, z.high, z.low, z.close, z.reach, k.pts,
      CASE WHEN k.side = 0 AND z.high >= k.top_h THEN z.idx ELSE k.top END AS top, CASE WHEN k.side = 0 AND z.high >= k.top_h THEN z.high ELSE k.top_h END AS top_h,
      CASE WHEN k.side = 0 AND z.high >= k.top_h THEN z.reach ELSE k.top_r END AS top_r,
      CASE WHEN k.side = 0 AND z.low <= k.bottom_l THEN z.idx ELSE k.bottom END AS bottom, CASE WHEN k.side = 0 AND z.low <= k.bottom_l THEN z.low ELSE k.bottom_l END AS bottom_l,
      CASE WHEN k.side = 0 AND z.low <= k.bottom_l THEN z.reach ELSE k.bottom_r END AS bottom_r,
      CASE WHEN k.side <> 0 AND (CASE WHEN k.side = 1 THEN z.high ELSE z.low END - k.best_v) * k.side >= 0 THEN z.idx ELSE k.best END AS best,
      CASE WHEN k.side <> 0 AND (CASE WHEN k.side = 1 THEN z.high ELSE z.low END - k.best_v) * k.side >= 0 THEN CASE WHEN k.side = 1 THEN z.high ELSE z.low END ELSE k.best_v END AS best_v,
      CASE WHEN k.side <> 0 AND (CASE WHEN k.side = 1 THEN z.high ELSE z.low END - k.best_v) * k.side >= 0 THEN z.reach ELSE k.best_r END AS best_r
    FROM zz k JOIN z ON z.symbol = k.symbol AND z.s = k.s AND z.idx = k.i + 1)))"""
PIVOTS = """lastz AS (SELECT symbol, max(idx) AS n FROM b GROUP BY symbol),
sets AS (SELECT zz.symbol, s, pts FROM zz JOIN lastz ON zz.symbol = lastz.symbol AND zz.i = lastz.n WHERE len(pts) >= 5
  QUALIFY row_number() OVER (PARTITION BY zz.symbol, list_transform(pts, lambda x: x.b * x.g) ORDER BY s) = 1),
pv AS (SELECT f.symbol, f.s AS sensitivity, CAST(k - 1 AS INTEGER) AS seq, f.x.b AS idx, b.ts, CASE WHEN f.x.g > 0 THEN 'HIGH' ELSE 'LOW' END AS kind, f.x.p AS price
  FROM (SELECT symbol, s, unnest(pts) AS x, generate_subscripts(pts, 1) AS k FROM sets) f JOIN b ON b.symbol = f.symbol AND b.idx = f.x.b)"""
BASE = (*PI.BASE, ATR, REACH, FOLD, PIVOTS)


def over(*views: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join((*BASE, *views)) + "\n" + body


def runs(n: int) -> str:
    return f"""q{n} AS (SELECT *, CASE WHEN kind = 'LOW' THEN 'BULLISH' ELSE 'BEARISH' END AS direction, CASE WHEN kind = 'LOW' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg FROM (
  SELECT symbol, sensitivity, seq, kind, list({{'idx': idx, 'ts': ts, 'price': price}}) OVER (PARTITION BY symbol, sensitivity ORDER BY seq ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS p FROM pv) WHERE len(p) = {n})"""


def P(k: int) -> str:
    """Price of point k, turned around for bearish counts."""
    return f"(p[{k + 1}].price * sg)"


def X(k: int) -> str:
    return f"p[{k + 1}].idx"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN abs({b}) >= 0.000001 THEN ({a}) / ({b}) END)"


ONE, THREE, FIVE = (f"({P(k + 1)} - {P(k)})" for k in (0, 2, 4))
TWO, FOUR = ratio(f"{P(1)} - {P(2)}", ONE), ratio(f"{P(3)} - {P(4)}", THREE)
BACK, RECOVERY = ratio(f"{P(5)} - {P(8)}", f"{P(5)} - {P(0)}"), ratio(f"{P(7)} - {P(6)}", f"{P(5)} - {P(6)}")
C_TO_A = ratio(f"{P(7)} - {P(8)}", f"{P(5)} - {P(6)}")


def legs(a: int, b: int) -> str:
    return " AND ".join(f"{X(k)} - {X(k - 1)} >= {V.LEG}" for k in range(a, b + 1))


IMPULSE = f"""{P(1)} > {P(0)} AND {P(2)} > {P(0)} AND {P(3)} > {P(1)} AND {P(4)} > {P(2)} AND {P(4)} > {P(1)} AND {TWO} > 0 AND {TWO} < 1 AND {FOUR} > 0 AND {FOUR} < 1
  AND {legs(1, 5)} AND {P(5)} > {P(4)} AND {THREE} >= least({ONE}, {FIVE})"""
CORRECTION = f"{IMPULSE} AND {P(6)} < {P(5)} AND {P(6)} > {P(0)} AND {P(7)} > {P(6)} AND {P(8)} < {P(7)} AND {RECOVERY} <= 2 AND {BACK} > 0 AND {BACK} < 1 AND {legs(6, 8)}"
VARIANT = f"CASE WHEN {P(7)} <= {P(5)} THEN 'STANDARD' WHEN {P(8)} < {P(6)} THEN 'EXPANDED_FLAT' ELSE 'RUNNING_FLAT' END"


def up(x: str) -> str:
    return f"floor(({x}) + 0.5)"


def quality(correction: bool) -> str:
    """Points of a count, from its moves, span, zones, alternation and origin."""
    t, f = V.TWO, V.FOUR
    span, short = f"({X(5)} - {X(0)})", ratio(THREE, ONE)
    parts = [
        "55", up(f"least(12.0, ({P(5)} - {P(0)}) / m)"),
        f"CASE WHEN {span} >= {V.SPAN} THEN least(8, ({span} - {V.SPAN}) // 5) ELSE -least(10, greatest(1, ({V.SPAN} - {span}) * 2)) END",
        f"CASE WHEN {THREE} >= {ONE} AND {THREE} >= {FIVE} THEN 7 ELSE 0 END",
        f"CASE WHEN {short} >= 0.8 THEN 0 ELSE -(6 + {up(f'least(1.0, (0.8 - greatest(0.0, {short})) / 0.8) * 8')}) END",
        f"CASE WHEN {TWO} BETWEEN {t[1]} AND {t[2]} THEN 5 ELSE 0 END",
        f"CASE WHEN {TWO} > {t[3]} AND {TWO} < 1 THEN -(8 + {up(f'least(1.0, ({TWO} - {t[3]}) / (1 - {t[3]}::DOUBLE)) * 12')}) WHEN {TWO} < {t[0]} THEN -6 ELSE 0 END",
        f"CASE WHEN {FOUR} BETWEEN {f[1]} AND {f[2]} THEN 5 ELSE 0 END",
        f"CASE WHEN {FOUR} < {f[0]} THEN -(6 + {up(f'least(1.0, ({f[0]} - {FOUR}) / {f[0]}) * 4')}) WHEN {FOUR} > {f[3]} THEN -(8 + {up(f'least(1.0, ({FOUR} - {f[3]}) / (1 - {f[3]}::DOUBLE)) * 8')}) ELSE 0 END",
        f"CASE WHEN {P(5)} <= {P(3)} THEN -18 ELSE 0 END", f"CASE WHEN abs({TWO} - {FOUR}) >= 0.08 THEN 3 ELSE 0 END",
        f"CASE WHEN origin / m <= 0.75 THEN 8 WHEN origin / m <= 1.5 THEN 3 ELSE -least(18, {up('origin / m * 3.0')}) END",
    ]
    if correction:
        lo, hi = V.CORRECTION
        n0, c0, c1, n1 = V.C_TO_A
        parts += [
            f"4 + CASE WHEN {BACK} BETWEEN {lo} AND {hi} THEN 4 WHEN {BACK} < {lo} THEN -(6 + {up(f'least(1.0, ({lo} - {BACK}) / {lo}) * 4')}) ELSE -(8 + {up(f'least(1.0, ({BACK} - {hi}) / (1 - {hi}::DOUBLE)) * 10')}) END",
            f"CASE WHEN {C_TO_A} BETWEEN {c0} AND {c1} THEN 5 WHEN {C_TO_A} BETWEEN {n0} AND {n1} THEN 0 WHEN {C_TO_A} < {n0} THEN -(6 + {up(f'least(1.0, ({n0} - {C_TO_A}) / {n0}) * 4')}) ELSE -(8 + least(8, {up(f'({C_TO_A} - {n1}) * 4')})) END",
            f"CASE {VARIANT} WHEN 'EXPANDED_FLAT' THEN -4 WHEN 'RUNNING_FLAT' THEN -14 ELSE 0 END",
        ]
    return "CAST(greatest(0, least(100, " + " + ".join(f"({x})" for x in parts) + ")) AS INTEGER)"


def counts(n: int, rule: str, stage: str) -> str:
    """Counts of n points that keep the rules, with their mean range and origin."""
    kind = VARIANT if stage == "C" else f"CASE WHEN {P(5)} <= {P(3)} THEN 'TRUNCATED' ELSE 'FULL' END"
    key = " || ':' || ".join(["direction", *[f"CAST(epoch(p[{k + 1}].ts)::BIGINT AS VARCHAR)" for k in range(5)]])
    return f"""{runs(n)},
g{n} AS (SELECT q.symbol, q.sensitivity, q.seq, any_value(q.p) AS p, any_value(q.sg) AS sg, any_value(q.direction) AS direction,
  greatest(0.000001::DOUBLE, sum(CASE WHEN r.idx >= q.p[1].idx THEN CASE WHEN r.atr > 0 THEN r.atr ELSE greatest(r.high - r.low, 0.000001::DOUBLE) END END) / (any_value(q.p)[-1].idx - any_value(q.p)[1].idx + 1)) AS m,
  greatest(0.0::DOUBLE, CASE WHEN any_value(q.sg) > 0 THEN any_value(q.p)[1].price - min(CASE WHEN r.idx <= q.p[1].idx THEN r.low END) ELSE max(CASE WHEN r.idx <= q.p[1].idx THEN r.high END) - any_value(q.p)[1].price END) AS origin
  FROM (SELECT *, greatest(1, {X(0)} - greatest(8, ({X(5)} - {X(0)}) // 2)) AS look FROM q{n} WHERE {rule}) q JOIN a r ON r.symbol = q.symbol AND r.idx BETWEEN q.look AND q.p[-1].idx GROUP BY q.symbol, q.sensitivity, q.seq),
s{n} AS (SELECT symbol, '1wk' AS "interval", sensitivity, direction, sg, '{stage}' AS stage, {quality(stage == 'C')} AS quality, {kind} AS variant, {key} AS cycle_key,
  p[1].idx AS start_idx, p[-1].idx AS end_idx, p[-1].ts AS end_ts, p[-1].price AS end_price, p FROM g{n})"""


STRUCTURES = f"""{counts(6, IMPULSE, 'V')},
{counts(9, CORRECTION, 'C')},
st AS (SELECT * FROM s6 UNION ALL SELECT * FROM s9)"""
BOUNDARIES = """bd AS (SELECT *, p[-2].price AS trigger, CASE WHEN stage = 'C' THEN p[1].price WHEN (p[2].price - p[1].price) * sg > (p[4].price - p[3].price) * sg THEN p[5].price + sg * ((p[4].price - p[3].price) * sg) END AS invalidation,
  CASE WHEN (stage = 'C') = (direction = 'BULLISH') THEN 'BUY' ELSE 'SELL' END AS side, list_max(list_transform(p, lambda x: x.price)) AS high, list_min(list_transform(p, lambda x: x.price)) AS low FROM st)"""
LIFECYCLE = """f AS (SELECT bd.symbol, bd."interval", bd.direction, stage, cycle_key, end_idx, side, trigger, invalidation, b.idx - end_idx AS off,
  CASE WHEN stage = 'V' THEN CASE WHEN direction = 'BULLISH' THEN b.high > invalidation ELSE b.low < invalidation END
    ELSE CASE WHEN direction = 'BULLISH' THEN b.low <= invalidation ELSE b.high >= invalidation END END AS broken,
  CASE WHEN side = 'BUY' THEN b.close > trigger ELSE b.close < trigger END AS confirmed
  FROM (SELECT DISTINCT symbol, "interval", direction, stage, cycle_key, end_idx, side, trigger, invalidation FROM bd) bd JOIN b ON b.symbol = bd.symbol AND b.idx BETWEEN end_idx + 1 AND end_idx + 10),
lc AS (SELECT symbol, "interval", direction, stage, cycle_key, end_idx, side, trigger, invalidation, min(off) FILTER (broken) AS broken_at, min(off) FILTER (confirmed) AS confirmed_at, count(*) AS seen FROM f GROUP BY ALL)"""
# the greedy choice, one structure after the other
CHOSEN = """hb AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY quality DESC, stage, end_idx - start_idx DESC, end_idx, direction) AS k FROM (
  SELECT symbol, "interval", direction, stage, quality, start_idx, end_idx, end_ts, cycle_key FROM st QUALIFY row_number() OVER (PARTITION BY symbol, direction, stage, end_ts ORDER BY quality DESC, start_idx, sensitivity) = 1)),
hg AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS k, []::STRUCT(a BIGINT, z BIGINT, k BIGINT)[] AS kept FROM hb UNION ALL
  SELECT h.symbol, h.k, CASE WHEN len(list_filter(g.kept, lambda x: least(x.z, h.end_idx) - greatest(x.a, h.start_idx) > 0.4::DOUBLE * least(h.end_idx - h.start_idx, x.z - x.a))) > 0 THEN g.kept
    ELSE list_append(g.kept, {'a': h.start_idx, 'z': h.end_idx, 'k': h.k}) END FROM hg g JOIN hb h ON h.symbol = g.symbol AND h.k = g.k + 1)"""
CONFIRMATION = f"""cf AS (SELECT st.symbol, st."interval", direction, stage, cycle_key, end_idx, min(r.idx - end_idx) AS lag
  FROM st JOIN (SELECT *, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM b {PI.WIN}) r ON r.symbol = st.symbol AND r.idx BETWEEN end_idx + 1 AND end_idx + {V.LAG}
    AND CASE WHEN (stage = 'C') = (direction = 'BULLISH') THEN r.close > ph ELSE r.close < pl END GROUP BY ALL)"""


def _percent(x: str) -> str:
    return f"(CAST({up(f'{x} * 1000')} / 10 AS VARCHAR) || '%')"


_LESS = "' — reduced confidence'"
_RATIO = ratio(THREE, ONE)
_UNUSUAL = {
    f"{TWO} > {V.TWO[3]} AND {TWO} < 1": f"'Deep Wave II ' || {_percent(TWO)}", f"{TWO} < {V.TWO[0]}": f"'Shallow Wave II ' || {_percent(TWO)}",
    f"{_RATIO} < 0.8": f"'Wave III is ' || {_percent(_RATIO)} || ' of Wave I'",
    f"{FOUR} > {V.FOUR[3]}": f"'Deep Wave IV ' || {_percent(FOUR)}", f"{FOUR} < {V.FOUR[0]}": f"'Shallow Wave IV ' || {_percent(FOUR)}",
    f"{X(5)} - {X(0)} < {V.SPAN}": f"'Compressed ' || CAST({X(5)} - {X(0)} AS VARCHAR) || '-candle impulse'", f"{P(5)} <= {P(3)}": "'Truncated Wave V'",
    f"stage = 'C' AND NOT {BACK} BETWEEN {V.CORRECTION[0]} AND {V.CORRECTION[1]}": f"'A–B–C retracement ' || {_percent(BACK)}",
    f"stage = 'C' AND NOT {C_TO_A} BETWEEN {V.C_TO_A[0]} AND {V.C_TO_A[3]}": f"'Wave C is ' || CAST({up(f'{C_TO_A} * 100')} / 100 AS VARCHAR) || '× Wave A'",
    "variant = 'EXPANDED_FLAT'": "'Expanded-flat candidate'", "variant = 'RUNNING_FLAT'": "'Running-flat candidate'",
}
WARNINGS = "list_filter([" + ", ".join(f"CASE WHEN {k} THEN {v} || {_LESS} END" for k, v in _UNUSUAL.items()) + "], lambda x: x IS NOT NULL)"
CONFIRMED = """cs AS (SELECT st.*, st.end_idx + lag AS confirm_idx, b.ts AS confirm_ts FROM st JOIN cf USING (symbol, direction, stage, cycle_key, end_idx) JOIN b ON b.symbol = st.symbol AND b.idx = st.end_idx + lag)"""
STAGES = f"""stages AS (SELECT '1wk' AS "interval", bars, least, stage, count(*) AS signals, count(*) FILTER (change >= move) AS successes, count(*) FILTER (change <= -move) AS failures,
  round(CASE WHEN count(*) FILTER (abs(change) >= move) > 0 THEN count(*) FILTER (change >= move) * 100.0::DOUBLE / count(*) FILTER (abs(change) >= move) END, 6) AS precision, round(avg(change), 6) AS average_return
  FROM (SELECT hz.bars, hz.move, least, unnest([stage, 'ALL']) AS stage, CASE WHEN (stage = 'C') = (direction = 'BULLISH') THEN 1 ELSE -1 END * ((x.close - e.close) / e.close * 100.0::DOUBLE) AS change
    FROM (SELECT DISTINCT symbol, direction, stage, cycle_key, quality, confirm_idx FROM cs) c JOIN b e ON e.symbol = c.symbol AND e.idx = confirm_idx
    CROSS JOIN (VALUES {', '.join(f'({n}, {m}::DOUBLE)' for n, m in V.STAGE_HORIZONS)}) hz(bars, move) CROSS JOIN (VALUES {', '.join(f'({q})' for q in V.STAGE_QUALITIES)}) q(least)
    JOIN b x ON x.symbol = c.symbol AND x.idx = confirm_idx + hz.bars WHERE quality >= least) GROUP BY ALL)"""
