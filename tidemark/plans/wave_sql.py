"""SQL of the wave signals: every bar's window of bars is folded anew, all windows of
all symbols in step, by a recursive view over the places in a window."""

from __future__ import annotations

from tidemark.operators import elliott as L
from tidemark.operators import waves as V
from tidemark.plans import elliott_sql as Q
from tidemark.plans import indicators as PI

P, X = Q.P, Q.X
# the bars of each window; where the average range is missing, the mean of the window's last 14 ranges
WINDOWS = f"""xx AS MATERIALIZED (SELECT *, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc FROM x {PI.WIN}),
wr AS (SELECT n.symbol, n.idx AS now, r.idx, r.high, r.low, r.close, r.atr,
    CASE WHEN r.atr > 0 THEN r.atr ELSE greatest(r.high - r.low, CASE WHEN r.idx > n.idx - {L.WINDOW - 1} AND r.pc IS NOT NULL THEN greatest(abs(r.high - r.pc), abs(r.low - r.pc)) END, 0.000001::DOUBLE) END AS used
  FROM xx n JOIN xx r ON r.symbol = n.symbol AND r.idx BETWEEN n.idx - {L.WINDOW - 1} AND n.idx WHERE n.idx >= {L.LEAST}),
wz AS MATERIALIZED (SELECT symbol, now, idx, idx - min(idx) OVER (PARTITION BY symbol, now) AS pos, high, low, close, (high + low) / 2 AS mid,
    CASE WHEN atr > 0 THEN atr ELSE avg(used) OVER (PARTITION BY symbol, now ORDER BY idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END AS volatility FROM wr)"""
_REACH = "greatest({0}.volatility * {1}, abs({0}.close) * 0.0125::DOUBLE * {1})"
# pts: bar numbers, those of lows negative; last_v is the last one's price
FOLD = f"""wf AS (
SELECT symbol, now, s, pos, 0 AS side, idx AS top, high AS top_h, {_REACH.format('wz', 's')} AS top_r, idx AS bottom, low AS bottom_l, {_REACH.format('wz', 's')} AS bottom_r,
  idx AS best, high AS best_v, {_REACH.format('wz', 's')} AS best_r, []::BIGINT[] AS pts, 0.0::DOUBLE AS last_v
FROM wz, (SELECT unnest({list(V.SENSITIVITIES)}::DOUBLE[]) AS s) WHERE pos = 0
UNION ALL
SELECT symbol, now, s, pos, CASE WHEN begins THEN first_side WHEN turns THEN -side ELSE side END, top, top_h, top_r, bottom, bottom_l, bottom_r,
  CASE WHEN begins THEN CASE WHEN first_side = 1 THEN top ELSE bottom END WHEN turns THEN idx ELSE best END,
  CASE WHEN begins THEN CASE WHEN first_side = 1 THEN top_h ELSE bottom_l END WHEN turns THEN back ELSE best_v END,
  CASE WHEN begins THEN CASE WHEN first_side = 1 THEN top_r ELSE bottom_r END WHEN turns THEN reach ELSE best_r END,
  CASE WHEN begins THEN [CASE WHEN first_side = 1 THEN -bottom ELSE top END] WHEN stays THEN pts WHEN sign(pts[-1]) = side THEN list_append(pts[:-2], side * best) ELSE list_append(pts, side * best) END,
  CASE WHEN begins THEN CASE WHEN first_side = 1 THEN bottom_l ELSE top_h END WHEN stays THEN last_v ELSE best_v END
FROM (SELECT *, NOT turns OR CASE WHEN sign(pts[-1]) = side THEN (best_v - last_v) * side <= 0 ELSE abs(pts[-1]) = best END AS stays FROM (
  SELECT *, side = 0 AND top_h - bottom_l >= greatest(top_r, bottom_r) AS begins, CASE WHEN bottom < top OR (bottom = top AND close >= mid) THEN 1 ELSE -1 END AS first_side,
    side <> 0 AND (best_v - back) * side >= best_r AND (best < idx OR (close - mid) * side <= 0) AS turns
  FROM (
    SELECT k.symbol, k.now, k.s, z.pos, z.idx, k.side, z.close, z.mid, z.reach, z.back, k.pts, k.last_v,
      CASE WHEN z.higher THEN z.idx ELSE k.top END AS top, CASE WHEN z.higher THEN z.high ELSE k.top_h END AS top_h, CASE WHEN z.higher THEN z.reach ELSE k.top_r END AS top_r,
      CASE WHEN z.lower THEN z.idx ELSE k.bottom END AS bottom, CASE WHEN z.lower THEN z.low ELSE k.bottom_l END AS bottom_l, CASE WHEN z.lower THEN z.reach ELSE k.bottom_r END AS bottom_r,
      CASE WHEN z.further THEN z.idx ELSE k.best END AS best, CASE WHEN z.further THEN z.ahead ELSE k.best_v END AS best_v, CASE WHEN z.further THEN z.reach ELSE k.best_r END AS best_r
    FROM (SELECT k.*, z.idx AS z_idx, {{'pos': z.pos, 'idx': z.idx, 'high': z.high, 'low': z.low, 'close': z.close, 'mid': z.mid, 'reach': {_REACH.format('z', 'k.s')},
        'higher': k.side = 0 AND z.high >= k.top_h, 'lower': k.side = 0 AND z.low <= k.bottom_l, 'ahead': CASE WHEN k.side = 1 THEN z.high ELSE z.low END, 'back': CASE WHEN k.side = 1 THEN z.low ELSE z.high END,
        'further': k.side <> 0 AND (CASE WHEN k.side = 1 THEN z.high ELSE z.low END - k.best_v) * k.side >= 0}} AS z
      FROM wf k JOIN wz z ON z.symbol = k.symbol AND z.now = k.now AND z.pos = k.pos + 1) k))))"""
# the last 5 or 8 points that begin with a low (g 1) or a high (g -1)
RUNS = f"""wp AS (SELECT symbol, now, s, pts FROM (SELECT symbol, now, s, arg_max(pts, pos) AS pts FROM wf GROUP BY symbol, now, s) WHERE len(pts) >= 5 QUALIFY row_number() OVER (PARTITION BY symbol, now, pts ORDER BY s) = 1),
wk AS MATERIALIZED (SELECT symbol, now, s, kind, g, pts[b:b + n - 1] AS pp, abs(pts[b + n - 1]) AS last, abs(pts[b + 3]) AS third_idx,
    CASE WHEN kind = 'C' THEN -g ELSE g END AS side FROM (
  SELECT *, CASE WHEN sign(pts[len(pts) - n + 1]) = -g THEN len(pts) - n + 1 ELSE len(pts) - n END AS b FROM wp, (VALUES ('IMPULSE', 5), ('V', 5), ('C', 8)) k(kind, n), (VALUES (1), (-1)) f(g) WHERE len(pts) >= n) WHERE b >= 1),
wt AS (SELECT k.symbol, k.now, k.s, k.kind, k.g, any_value(pp) AS pp, any_value(last) AS last_idx, min(r.idx) AS turn
  FROM (SELECT k.*, CASE WHEN g > 0 THEN t.high * {L.BREAKOUT}::DOUBLE ELSE t.low / {L.BREAKOUT}::DOUBLE END AS level FROM wk k JOIN xx t ON t.symbol = k.symbol AND t.idx = third_idx WHERE kind = 'IMPULSE') k
  JOIN xx r ON r.symbol = k.symbol AND r.idx BETWEEN last + 1 AND now AND (r.close - level) * g > 0 GROUP BY k.symbol, k.now, k.s, k.kind, k.g
  UNION ALL
  SELECT e.symbol, e.now, e.s, e.kind, e.g, list_append(any_value(pp), any_value(e.end_idx * e.side)), any_value(e.end_idx), min(r.idx)
  FROM (SELECT k.symbol, k.now, k.s, k.kind, k.g, any_value(pp) AS pp, any_value(side) AS side, arg_max(r.idx, {{'v': CASE WHEN side > 0 THEN r.high ELSE -r.low END, 'i': -r.idx}}) AS end_idx
    FROM wk k JOIN xx r ON r.symbol = k.symbol AND r.idx BETWEEN last + 1 AND now - 1 WHERE kind <> 'IMPULSE' GROUP BY k.symbol, k.now, k.s, k.kind, k.g) e
  JOIN xx r ON r.symbol = e.symbol AND r.idx BETWEEN end_idx + 1 AND now AND CASE WHEN e.side > 0 THEN r.close < r.pl ELSE r.close > r.ph END GROUP BY e.symbol, e.now, e.s, e.kind, e.g),
wu AS (SELECT symbol, now, s, kind, g, turn, last_idx, unnest(pp) AS y, generate_subscripts(pp, 1) AS o FROM wt WHERE turn >= now - {L.PRESENT}),
wc AS (SELECT u.symbol, now, s AS sensitivity, kind, CASE WHEN g > 0 THEN 'BULLISH' ELSE 'BEARISH' END AS direction, CAST(g AS DOUBLE) AS sg, turn, last_idx AS end_idx,
    list({{'idx': r.idx, 'price': CASE WHEN y > 0 THEN r.high ELSE r.low END}} ORDER BY o) AS p
  FROM wu u JOIN xx r ON r.symbol = u.symbol AND r.idx = abs(y) GROUP BY ALL)"""


def case(when: str, a: object, b: object = 0) -> str:
    return f"(CASE WHEN {when} THEN {a} ELSE {b} END)"


def between(x: str, lo: float, hi: float) -> str:
    return f"{x} BETWEEN {lo} AND {hi}"


ONE, THREE, FIVE, TWO, FOUR, BACK, CA = Q.ONE, Q.THREE, Q.FIVE, Q.TWO, Q.FOUR, Q.BACK, Q.C_TO_A
C3, SPAN = Q.ratio(THREE, ONE), f"({X(5)} - {X(0)})"
BEGUN = f"{P(1)} > {P(0)} AND {P(2)} > {P(0)} AND {P(3)} > {P(1)} AND {P(4)} > {P(2)} AND {P(4)} > {P(1)} AND {TWO} > 0 AND {TWO} < 1 AND {FOUR} > 0 AND {FOUR} < 1 AND {Q.legs(1, 4)}"
BUYS = "((direction = 'BULLISH') <> (kind = 'V'))"
MORE = f"CASE WHEN {BUYS} THEN c.close >= b.close OR c.high > b.high ELSE c.close <= b.close OR c.low < b.low END"
STILL = f"CASE WHEN kind <> 'IMPULSE' THEN true WHEN {BUYS} THEN c.close > p[4].price * {L.BREAKOUT}::DOUBLE ELSE c.close < p[4].price / {L.BREAKOUT}::DOUBLE END"
VALID = f"CASE kind WHEN 'IMPULSE' THEN {BEGUN} WHEN 'V' THEN {Q.IMPULSE} ELSE {Q.CORRECTION} END"


def share(x: str, of: str, most: int) -> str:
    return Q.up(f"least(1.0, ({x}) / ({of})) * {most}")


def span_points(span: str) -> str:
    return case(f"{span} >= {V.SPAN}", 0, f"-least(10, greatest(1, ({V.SPAN} - {span}) * 2))")


_T, _F, _N = V.TWO, V.FOUR, V.C_TO_A
TWO_POINTS = f"(CASE WHEN {TWO} > {_T[3]} AND {TWO} < 1 THEN -(8 + {share(f'{TWO} - {_T[3]}', f'1 - {_T[3]}::DOUBLE', 12)}) WHEN {TWO} < {_T[0]} THEN -6 ELSE 0 END)"
THREE_POINTS = case(f"{C3} >= 0.8", 0, f"-(6 + {share(f'0.8 - greatest(0.0, {C3})', '0.8', 8)})")
FOUR_POINTS = f"(CASE WHEN {FOUR} < {_F[0]} THEN -(6 + {share(f'{_F[0]} - {FOUR}', f'{_F[0]}', 4)}) WHEN {FOUR} > {_F[3]} THEN -(8 + {share(f'{FOUR} - {_F[3]}', f'1 - {_F[3]}::DOUBLE', 8)}) ELSE 0 END)"
BACK_POINTS = f"(CASE WHEN {BACK} < {V.CORRECTION[0]} THEN -(6 + {share(f'{V.CORRECTION[0]} - {BACK}', f'{V.CORRECTION[0]}', 4)}) WHEN {BACK} > {V.CORRECTION[1]} THEN -(8 + {share(f'{BACK} - {V.CORRECTION[1]}', f'1 - {V.CORRECTION[1]}::DOUBLE', 10)}) ELSE 0 END)"
CA_POINTS = f"(CASE WHEN {CA} < {_N[0]} THEN -(6 + {share(f'{_N[0]} - {CA}', f'{_N[0]}', 4)}) WHEN {CA} > {_N[3]} THEN -(8 + least(8, {Q.up(f'({CA} - {_N[3]}) * 4')})) ELSE 0 END)"
TRUNCATED = case(f"{P(5)} <= {P(3)}", -V.TRUNCATION)
VARIANT_POINTS = f"(CASE {Q.VARIANT} WHEN 'EXPANDED_FLAT' THEN -4 WHEN 'RUNNING_FLAT' THEN -14 ELSE 0 END)"
AHEAD = case("CASE WHEN direction = 'BULLISH' THEN c.close > c.ema_fast ELSE c.close < c.ema_fast END", 7)
SURGE = case("c.volume > c.average_volume * 1.2", 5)


def rsi(bull: tuple[int, int], bear: tuple[int, int]) -> str:
    return case(f"CASE WHEN direction = 'BULLISH' THEN {between('c.rsi', *bull)} ELSE {between('c.rsi', *bear)} END", 5)


def clamped(start: int, parts: list[str]) -> str:
    return "list_reduce([" + ", ".join([str(start), *[f"coalesce(CAST({x} AS INTEGER), 0)" for x in parts]]) + "], lambda a, x: greatest(0, least(100, a + x)))"


_IMPULSE = clamped(60, [
    case(between(TWO, _T[0], _T[3]), 5, TWO_POINTS), case(between(TWO, _T[1], _T[2]), 5), case(f"{THREE} >= {ONE}", 10, THREE_POINTS),
    case(between(FOUR, _F[0], _F[3]), 5, FOUR_POINTS), case(between(FOUR, _F[1], _F[2]), 5), AHEAD,
    case("CASE WHEN direction = 'BULLISH' THEN c.ema_fast > e.ema_fast ELSE c.ema_fast < e.ema_fast END", 5), rsi((45, 72), (28, 55)), SURGE,
    case("kind = 'V'", span_points(SPAN), span_points(f"({X(4)} - {X(0)} + {V.LEG})")), case("kind = 'V'", TRUNCATED),
])
_CORRECTION = clamped(62, [
    case(between(BACK, *V.CORRECTION), 8, BACK_POINTS), case(between(BACK, 0.382, 0.618), 8), case(between(CA, _N[0], _N[3]), 5, CA_POINTS), case(between(CA, _N[1], _N[2]), 5), VARIANT_POINTS,
    AHEAD, rsi((40, 68), (32, 60)), SURGE, TWO_POINTS, THREE_POINTS, FOUR_POINTS, span_points(SPAN), TRUNCATED,
])
NAME = f"""'ELLIOTT_' || direction || '_' || CASE kind WHEN 'IMPULSE' THEN 'IMPULSE' WHEN 'V' THEN {case(f"{P(5)} <= {P(3)}", "'TRUNCATED_WAVE_V_END'", "'WAVE_V_END'")}
  ELSE CASE {Q.VARIANT} WHEN 'STANDARD' THEN 'CORRECTION' ELSE {Q.VARIANT} || '_CORRECTION' END END"""
SCORED = f"""wn AS MATERIALIZED (SELECT w.*, c, b, e, t, r FROM wc w JOIN xx c ON c.symbol = w.symbol AND c.idx = now JOIN xx b ON b.symbol = w.symbol AND b.idx = now - 1 LEFT JOIN xx e ON e.symbol = w.symbol AND e.idx = now - 3
    JOIN xx t ON t.symbol = w.symbol AND t.idx = end_idx JOIN xx r ON r.symbol = w.symbol AND r.idx = CASE WHEN kind = 'C' THEN p[7].idx ELSE p[4].idx END WHERE {VALID}),
we AS (SELECT *, CASE WHEN kind = 'C' THEN {_CORRECTION} ELSE {_IMPULSE} END AS eligibility, CASE WHEN {BUYS} THEN 'BUY' ELSE 'SELL' END AS side, {NAME} AS pattern FROM wn WHERE turn = now OR ({MORE} AND {STILL}))"""


def signed(a: str, b: str) -> str:
    return f"(CASE WHEN side = 'BUY' THEN {a} > {b} ELSE {a} < {b} END)"


def zone(x: str, common: tuple, normal: tuple, a: int, b: int) -> str:
    return f"(CASE WHEN {between(x, *common)} THEN {a} WHEN {between(x, *normal)} THEN {b} ELSE 0 END)"


def either(c: str, v: str) -> str:
    return case("kind = 'C'", c, v)


def total(*parts: str) -> str:
    return "(" + " + ".join(parts) + ")"


_TZ, _FZ = ((_T[1], _T[2]), (_T[0], _T[3])), ((_F[1], _F[2]), (_F[0], _F[3]))
APART = f"abs({TWO} - {FOUR}) >= 0.12"
LONG = f"{SPAN} >= {V.SPAN}"
TOP = "((direction = 'BULLISH') <> (kind = 'C'))"
OUTER = f"CASE WHEN {TOP} THEN t.high >= t.band_upper ELSE t.low <= t.band_lower END"


def fades(x: str) -> str:
    return f"CASE WHEN {TOP} THEN t.{x} < r.{x} ELSE t.{x} > r.{x} END"


def evenly(n: int) -> str:
    return f"least({', '.join(f'{X(k)} - {X(k - 1)}' for k in range(1, n + 1))}) >= {V.LEG}"


_FAMILIES = {
    "structure": (30, either(
        total("6", f"greatest(0, least(16, {Q.up(f'(eligibility - {L.ALERT}) * 16.0 / 25.0')}))", case(f"{THREE} >= {ONE}", 2), "3", case(f"{Q.VARIANT} = 'STANDARD'", 1), case(LONG, 2)),
        total("18", case(f"{THREE} >= {ONE}", 5), case(f"{P(5)} > {P(3)}", 3), case(LONG, 2), case(evenly(5), 2)))),
    "proportion": (20, either(
        total(zone(BACK, (0.382, 0.618), V.CORRECTION, 6, 4), zone(CA, (_N[1], _N[2]), (_N[0], _N[3]), 6, 4), zone(TWO, *_TZ, 3, 2), zone(FOUR, *_FZ, 3, 2), case(APART, 2)),
        total(zone(TWO, *_TZ, 5, 3), zone(FOUR, *_FZ, 5, 3), case(APART, 4, 2), case(between(C3, 1.0, 2.618), 3), case(between(Q.ratio(FIVE, ONE), 0.382, 2.618), 3)))),
    "momentum": (15, total(case(fades("rsi"), either("5", "6")), case(fades("macd_histogram"), either("4", "5")), case(signed("c.rsi", "b.rsi"), 2), case(signed("c.macd_histogram", "b.macd_histogram"), 2),
        case("kind = 'C' AND CASE WHEN side = 'BUY' THEN c.rsi < 70 ELSE c.rsi > 30 END", 2))),
    "confirmation": (15, total("7", case(signed("c.close", "c.open"), 3), case("c.high > c.low AND CASE WHEN side = 'BUY' THEN (c.close - c.low) / (c.high - c.low) >= 0.65 ELSE (c.close - c.low) / (c.high - c.low) <= 0.35 END", 3), case(signed("c.close", "c.ema_fast"), 2))),
    "levels": (10, total(either(total(case(signed("c.close", "c.ema_fast"), 3), case(signed("c.close", "c.ema_slow"), 3), case(OUTER, 2)),
        total(case(OUTER, 4), case("c.close < c.band_upper AND c.close > c.band_lower", 2), case("t.atr > 0 AND abs(t.close - t.sma_long) >= t.atr * 2.0", 2))), case(signed("c.close", "c.vwap"), 2))),
    "volume_points": (5, total(case("t.volume <= r.volume", either("2", "3")), case("c.average_volume > 0 AND c.volume >= c.average_volume * 1.2", either("3", "2")))),
    "timing": (5, total(case(LONG, 3), case(either(f"({evenly(8)})", f"({evenly(5)})"), 2))),
}
_PARTS = ", ".join(f"CASE WHEN kind = 'IMPULSE' THEN 0 ELSE CAST(least({n}, {x}) AS INTEGER) END AS {k}" for k, (n, x) in _FAMILIES.items())
SIGNALS = f"""ws AS (SELECT symbol, '1wk' AS "interval", now AS idx, c.ts AS ts, kind, pattern, direction, side, turn, eligibility, CASE WHEN kind = 'IMPULSE' THEN eligibility ELSE least(100, {' + '.join(_FAMILIES)}) END AS score,
  {', '.join(_FAMILIES)}, c.close AS price, end_idx, p[-1].price AS end_price, p[4].price AS third
  FROM (SELECT *, {_PARTS} FROM we) QUALIFY row_number() OVER (PARTITION BY symbol, now, kind, side ORDER BY eligibility DESC, sensitivity) = 1),
wl AS MATERIALIZED (SELECT *, CASE WHEN score < {L.ALERT} THEN 'LOW_CONFIDENCE' WHEN score >= {L.STRONG} THEN 'HIGH_CONFIDENCE' ELSE 'MEDIUM_CONFIDENCE' END AS strength FROM ws)"""
VIEWS = (*PI.BASE, *PI.ENRICHED, WINDOWS, FOLD, RUNS, SCORED, SIGNALS)


def over(*views: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join((*VIEWS, *views)) + "\n" + body
