"""Queries of back-tests, lifecycles and statistics, on weekly bars, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import bootstrap as BS
from tidemark.operators import indicators as I
from tidemark.operators import matched as MC
from tidemark.operators import patterns as P
from tidemark.plans import patterns as Q
from tidemark.plans import sql as S
from tidemark.plans.catalog import query
from tidemark.sources import market as M
from tidemark.sources.files import written

FWD, MOVE = B.HORIZONS["1wk"]
HISTORY = 21
_ID = ["symbol", "interval", "ts", "pattern", "direction"]


def future(spark, sf_dir, interval="1wk", fwd=FWD):
    return B.with_future(P.prepared(M.bars(spark, sf_dir, interval), interval), fwd)


def weekly_trades(spark, sf_dir):
    return B.trades(P.detected(future(spark, sf_dir), hold=False), HISTORY, MOVE)


def engulfing_report(spark, sf_dir):
    """Monthly engulfings, back-tested: the flagship."""
    fwd, move = B.HORIZONS["1mo"]
    t = B.trades(P.detected(future(spark, sf_dir, "1mo", fwd), ("BULLISH_ENGULFING", "BEARISH_ENGULFING")), 13, move)
    return B.report(t, "pattern")


_A = f"ROWS BETWEEN 1 FOLLOWING AND {FWD} FOLLOWING"
FUTURE = f"""fu AS (SELECT symbol, ts, lead(ts, {FWD}) OVER w AS exit_ts, lead(close, {FWD}) OVER w AS exit_close, max(high) OVER (w {_A}) AS max_high, min(low) OVER (w {_A}) AS min_low
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


def trades_sql(signals: str) -> str:
    return f"""tr AS (SELECT *, CASE WHEN close_return >= {MOVE} THEN 'SUCCESS' WHEN close_return <= -{MOVE} THEN 'FAILURE' ELSE 'INCONCLUSIVE' END AS outcome FROM (
  SELECT {signals}.*, exit_ts, close AS entry_price, CASE WHEN direction = 'BUY' THEN (exit_close - close) / close * 100.0::DOUBLE ELSE -((exit_close - close) / close * 100.0::DOUBLE) END AS close_return,
    CASE WHEN direction = 'BUY' THEN max_high - close ELSE close - min_low END / close * 100.0::DOUBLE AS best_move, CASE WHEN direction = 'BUY' THEN min_low - close ELSE close - max_high END / close * 100.0::DOUBLE AS worst_move
  FROM {signals} JOIN fu USING (symbol, ts) WHERE direction <> 'HOLD' AND exit_ts IS NOT NULL AND idx >= {HISTORY}))"""


TRADES = trades_sql("d")
CTES = (*Q.PREP, Q.DETECTED, FUTURE, TRADES)
N = "count(*) FILTER (outcome = '{}')"
_S, _Fl, _In = N.format("SUCCESS"), N.format("FAILURE"), N.format("INCONCLUSIVE")
MEASURES = f"""count(*) AS signals, count(*) FILTER (direction = 'BUY') AS buys, count(*) FILTER (direction = 'SELL') AS sells, {_S} AS successes, {_Fl} AS failures, {_In} AS inconclusive,
  round({_S} * 100.0::DOUBLE / count(*), 6) AS success_rate, round(CASE WHEN {_S} + {_Fl} > 0 THEN {_S} * 100.0::DOUBLE / ({_S} + {_Fl}) END, 6) AS precision, round(avg(close_return), 6) AS average_return"""


def ora(body, *more):
    return S.over(*CTES, *more, body=body)


@query("backtest_trades", ora('SELECT symbol, "interval", ts, pattern, direction, exit_ts, round(entry_price, 6) AS entry_price, round(close_return, 6) AS close_return, round(best_move, 6) AS best_move, round(worst_move, 6) AS worst_move, outcome FROM tr'))
def backtest_trades(spark, sf_dir):
    return weekly_trades(spark, sf_dir).select(*_ID, "exit_ts", *[F.round(c, 6).alias(c) for c in ("entry_price", "close_return", "best_move", "worst_move")], "outcome")


@query("backtest_report", ora(f"SELECT pattern, {MEASURES} FROM tr GROUP BY pattern"))
def backtest_report(spark, sf_dir):
    return B.report(weekly_trades(spark, sf_dir), "pattern")


@query("cohort_stats", ora(f"SELECT coalesce(symbol, 'ALL') AS symbol, coalesce(direction, 'ALL') AS side, {MEASURES.replace('count(*) FILTER (direction', 'count(*) FILTER (dir').replace('AS buys', 'AS buys')} FROM (SELECT *, direction AS dir FROM tr) GROUP BY GROUPING SETS ((symbol, direction), (symbol), (direction), ())"))
def cohort_stats(spark, sf_dir):
    t = weekly_trades(spark, sf_dir).withColumn("side", F.col("direction"))
    return t.cube("symbol", "side").agg(*B.measures()).withColumns({"symbol": F.coalesce("symbol", F.lit("ALL")), "side": F.coalesce("side", F.lit("ALL"))})


@query("temporal_split", ora(f"SELECT CASE WHEN exit_ts < TIMESTAMP '1999-01-01' THEN 'DEVELOPMENT' WHEN ts >= TIMESTAMP '1999-01-01' THEN 'VALIDATION' ELSE 'STRADDLES' END AS segment, {MEASURES} FROM tr GROUP BY segment"))
def temporal_split(spark, sf_dir):
    cut = F.lit("1999-01-01").cast("timestamp")
    segment = F.when(F.col("exit_ts") < cut, "DEVELOPMENT").when(F.col("ts") >= cut, "VALIDATION").otherwise("STRADDLES")
    return B.report(weekly_trades(spark, sf_dir).withColumn("segment", segment), "segment")


_Z = 1.959963984540054


@query("wilson_interval", ora(f"""SELECT pattern, s, n, round(CASE WHEN n > 0 THEN (p + z2 / (2 * n) - h) / (1 + z2 / n) * 100 END, 6) AS low, round(CASE WHEN n > 0 THEN (p + z2 / (2 * n) + h) / (1 + z2 / n) * 100 END, 6) AS high FROM (
  SELECT *, {_Z}::DOUBLE * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) AS h FROM (SELECT pattern, {_S} AS s, {_S} + {_Fl} AS n, {_S} / nullif({_S} + {_Fl}, 0)::DOUBLE AS p, {_Z}::DOUBLE * {_Z}::DOUBLE AS z2 FROM tr GROUP BY pattern))"""))
def wilson_interval(spark, sf_dir):
    t = weekly_trades(spark, sf_dir).groupBy("pattern").agg(F.count_if(F.col("outcome") == "SUCCESS").alias("s"), F.count_if(F.col("outcome").isin("SUCCESS", "FAILURE")).alias("n"))
    low, high = B.wilson(F.col("s").cast("double"), F.nullif(F.col("n").cast("double"), F.lit(0.0)))
    return t.select("pattern", "s", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("shrunk_precision", ora(f"""SELECT pattern, o.direction, s, n, round((s + 30 * ps) / (n + 30) * 100, 6) AS shrunk, round(((s + 30 * ps) / (n + 30) - ps) * 100, 6) AS lift
FROM (SELECT pattern, direction, {_S} AS s, {_S} + {_Fl} AS n FROM tr GROUP BY ALL) o JOIN (SELECT direction, {_S} / nullif({_S} + {_Fl}, 0)::DOUBLE AS ps FROM tr GROUP BY ALL) q USING (direction)"""))
def shrunk_precision(spark, sf_dir):
    return B.shrunk_precision(weekly_trades(spark, sf_dir))


@query("percentile_linear", ora("SELECT direction, round(quantile_cont(close_return, 0.05), 6) AS p05, round(quantile_cont(close_return, 0.5), 6) AS p50, round(quantile_cont(close_return, 0.95), 6) AS p95 FROM tr GROUP BY direction"))
def percentile_linear(spark, sf_dir):
    p = [F.round(F.percentile("close_return", F.lit(q)), 6).alias(f"p{round(q * 100):02d}") for q in (0.05, 0.5, 0.95)]
    return weekly_trades(spark, sf_dir).groupBy("direction").agg(*p)


@query("execution_metrics", ora("""SELECT direction, count(*) AS n, round(avg(close_return), 6) AS gross, round(avg(close_return) - 0.20, 6) AS net, round(median(close_return), 6) AS middle, round(avg(best_move), 6) AS mfe, round(avg(worst_move), 6) AS mae,
  round(count(*) FILTER (close_return > 0) * 100.0::DOUBLE / count(*), 6) AS gross_positive, round(count(*) FILTER (close_return - 0.20::DOUBLE > 0) * 100.0::DOUBLE / count(*), 6) AS net_positive FROM tr GROUP BY direction"""))
def execution_metrics(spark, sf_dir):
    r = F.col("close_return")
    return weekly_trades(spark, sf_dir).groupBy("direction").agg(
        F.count("*").alias("n"), F.round(F.avg(r), 6).alias("gross"), F.round(F.avg(r) - B.COST, 6).alias("net"), F.round(F.percentile(r, F.lit(0.5)), 6).alias("middle"), F.round(F.avg("best_move"), 6).alias("mfe"), F.round(F.avg("worst_move"), 6).alias("mae"),
        F.round(F.count_if(r > 0) * 100.0 / F.count("*"), 6).alias("gross_positive"), F.round(F.count_if(r - B.COST > 0) * 100.0 / F.count("*"), 6).alias("net_positive"),
    )


@query("equal_coverage_quartile", ora(f"""SELECT direction, {MEASURES.replace('direction = ', 'direction = ')} FROM (SELECT *, CAST({Q.TREND} AS INTEGER) AS points FROM tr) QUALIFY false""").replace("QUALIFY false", "").replace("FROM (SELECT *, CAST(", "FROM (SELECT *, ntile(4) OVER (ORDER BY CAST(").replace(" AS INTEGER) AS points FROM tr)", " AS INTEGER) DESC, symbol, ts, pattern) AS quartile FROM tr) WHERE quartile = 1 GROUP BY direction"))
def equal_coverage_quartile(spark, sf_dir):
    from pyspark.sql import Window

    t = weekly_trades(spark, sf_dir).withColumn("points", P.score_trend())
    # rank within the whole set by counts per score, so no single task sorts all signals
    t = t.select(*_ID, "points", "outcome", "close_return")
    per = t.groupBy("points").agg(F.count("*").alias("n"))
    above = per.alias("a").join(per.alias("b"), F.col("b.points") > F.col("a.points"), "left").groupBy(F.col("a.points").alias("points")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    total = per.agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("points").orderBy("symbol", "ts", "pattern")) + F.col("before")
    t = t.join(F.broadcast(above), "points").join(F.broadcast(total)).withColumn("place", place)
    top = F.floor(F.col("total") / 4) + F.when(F.col("total") % 4 > 0, 1).otherwise(0)
    return B.report(t.filter(F.col("place") <= top), "direction")


_FILTERS = [(f"{a}-{b}", a, b) for a in (50, 60, 70, 75, 80, 85) for b in (79, 89, 100) if a < b]


_SCORED = (*Q.SCORED, FUTURE, trades_sql("st"), "filters(filter, least, most) AS (VALUES " + ", ".join(map(str, _FILTERS)) + ")")
_SWEEP = f"""SELECT filters.filter, filters."least", filters."most", {MEASURES} FROM tr JOIN filters ON setup_score BETWEEN filters."least" AND filters."most" GROUP BY ALL"""


@query("threshold_sweep", S.over(*_SCORED, body=_SWEEP))
def threshold_sweep(spark, sf_dir):
    t = B.trades(P.scored(future(spark, sf_dir), "1wk"), HISTORY, MOVE)
    return B.threshold_sweep(t, spark.createDataFrame(_FILTERS, "filter string, least int, most int"))


@query("best_runs", S.over(*_SCORED, body=f"SELECT * FROM ({_SWEEP}) WHERE signals >= 30 ORDER BY precision DESC NULLS LAST, signals DESC, filter LIMIT 10"))
def best_runs(spark, sf_dir):
    return threshold_sweep(spark, sf_dir).filter("signals >= 30").orderBy(F.desc("precision"), F.desc("signals"), "filter").limit(10)


@query("score_buckets", S.over(*Q.SCORED, FUTURE, trades_sql("st"), body=f"""SELECT CASE WHEN setup_score < 50 THEN '0-49' WHEN setup_score < 60 THEN '50-59' WHEN setup_score < 70 THEN '60-69' WHEN setup_score < 80 THEN '70-79' ELSE '80-100' END AS bucket, {MEASURES} FROM tr GROUP BY bucket"""))
def score_buckets(spark, sf_dir):
    t = B.trades(P.scored(future(spark, sf_dir), "1wk"), HISTORY, MOVE)
    return B.report(t.withColumn("bucket", B.score_bucket(F.col("setup_score"))), "bucket")


@query("component_cohorts", ora(f"""SELECT component, {MEASURES} FROM (SELECT *, unnest(['quality', 'trend', 'momentum', 'bands']) AS component, unnest([{Q.QUALITY}, {Q.TREND}, {Q.MOMENTUM}, {Q.BANDS}]) AS earned FROM tr) WHERE earned > 0 GROUP BY component"""))
def component_cohorts(spark, sf_dir):
    t = weekly_trades(spark, sf_dir).withColumn("geometry", P.score_geometry())
    parts = F.array(*[F.struct(F.lit(k).alias("component"), c.cast("int").alias("earned")) for k, c in {"quality": P.score_quality(), "trend": P.score_trend(), "momentum": P.score_momentum(), "bands": P.score_bands()}.items()])
    return B.report(t.withColumn("part", F.explode(parts)).filter("part.earned > 0").withColumn("component", F.col("part.component")), "component")


@query("coverage_stats", ora('SELECT "interval", count_if(n >= 139) AS sufficient, CAST(sum(n) AS BIGINT) AS bars, CAST(sum(CASE WHEN n >= 139 THEN n ELSE 0 END) AS BIGINT) AS analysed, CAST(coalesce(sum(s), 0) AS BIGINT) AS signals FROM (SELECT symbol, "interval", count(*) AS n FROM b GROUP BY ALL) LEFT JOIN (SELECT symbol, count(*) AS s FROM d GROUP BY symbol) USING (symbol) GROUP BY "interval"'))
def coverage_stats(spark, sf_dir):
    p = P.prepared(M.bars(spark, sf_dir), "1wk")
    s = P.detected(p).groupBy("symbol", "interval").agg(F.count("*").alias("s"))
    n = p.groupBy("symbol", "interval").agg(F.count("*").alias("n")).join(s, ["symbol", "interval"], "left")
    return n.groupBy("interval").agg(F.count_if(F.col("n") >= 139).alias("sufficient"), F.sum("n").alias("bars"), F.sum(F.when(F.col("n") >= 139, F.col("n")).otherwise(0)).alias("analysed"), F.sum(F.coalesce("s", F.lit(0).cast("long"))).alias("signals"))


# ---------------------------------------------------------------- lifecycle

INIT = """li AS (SELECT *, CASE WHEN direction = 'BUY' THEN fh ELSE fl END AS trigger, CASE WHEN direction = 'BUY' THEN fl ELSE fh END AS invalidation FROM (
  SELECT *, CASE size WHEN 1 THEN high WHEN 2 THEN greatest(high, p_high) ELSE greatest(high, p_high, f_high) END AS fh, CASE size WHEN 1 THEN low WHEN 2 THEN least(low, p_low) ELSE least(low, p_low, f_low) END AS fl FROM d WHERE direction <> 'HOLD'))"""
RESOLVE = """fb AS (SELECT li.symbol, li.ts, li.pattern, n.idx - li.idx AS k, n.close AS c, li.direction, trigger, invalidation FROM li JOIN b n ON n.symbol = li.symbol AND n.idx BETWEEN li.idx + 1 AND li.idx + 3),
fh AS (SELECT *, CASE WHEN CASE WHEN direction = 'BUY' THEN c > trigger ELSE c < trigger END THEN 'CONFIRMED' WHEN CASE WHEN direction = 'BUY' THEN c < invalidation ELSE c > invalidation END THEN 'INVALIDATED' END AS hit FROM fb),
fs AS (SELECT symbol, ts, pattern, arg_min(hit, k) FILTER (hit IS NOT NULL) AS hit, min(k) FILTER (hit IS NOT NULL) AS first_at, count(*) AS seen FROM fh GROUP BY ALL),
lr AS (SELECT li.symbol, li."interval", li.ts, li.pattern, li.direction, trigger, invalidation, CASE WHEN hit IS NOT NULL THEN hit WHEN seen >= 3 THEN 'EXPIRED' ELSE 'DETECTED' END AS status, CAST(coalesce(first_at, CASE WHEN seen >= 3 THEN 3 END) AS INTEGER) AS resolution_offset
  FROM li LEFT JOIN fs USING (symbol, ts, pattern))"""


def resolved(spark, sf_dir):
    p = P.prepared(M.bars(spark, sf_dir), "1wk")
    return B.lifecycle_resolve(B.lifecycle_init(P.detected(p, hold=False)), I.indexed(M.bars(spark, sf_dir)))


@query("lifecycle_init", S.over(*Q.PREP, Q.DETECTED, INIT, body='SELECT symbol, "interval", ts, pattern, direction, trigger, invalidation FROM li'))
def lifecycle_init(spark, sf_dir):
    return B.lifecycle_init(P.detected(P.prepared(M.bars(spark, sf_dir), "1wk"), hold=False)).select(*_ID, "trigger", "invalidation")


@query("lifecycle_resolve", S.over(*Q.PREP, Q.DETECTED, INIT, RESOLVE, body="SELECT * FROM lr"))
def lifecycle_resolve(spark, sf_dir):
    return resolved(spark, sf_dir)


@query("lifecycle_summary", S.over(*Q.PREP, Q.DETECTED, INIT, RESOLVE, body="SELECT direction, status, count(*) AS n, round(avg(resolution_offset), 6) AS mean_delay FROM lr GROUP BY ALL"))
def lifecycle_summary(spark, sf_dir):
    return resolved(spark, sf_dir).groupBy("direction", "status").agg(F.count("*").alias("n"), F.round(F.avg("resolution_offset"), 6).alias("mean_delay"))


@query("forward_bars", S.over(*Q.PREP, Q.DETECTED, body="SELECT d.symbol, d.ts, pattern, CAST(n.idx - d.idx AS INTEGER) AS \"offset\", n.ts AS f_ts, n.close AS f_close FROM d JOIN b n ON n.symbol = d.symbol AND n.idx BETWEEN d.idx + 1 AND d.idx + 3 WHERE direction <> 'HOLD'"))
def forward_bars(spark, sf_dir):
    p = P.prepared(M.bars(spark, sf_dir), "1wk")
    return B.forward_bars(P.detected(p, hold=False), I.indexed(M.bars(spark, sf_dir)), 3).select("symbol", "ts", "pattern", "offset", "f_ts", "f_close")


@query("result_path", S.over(*Q.PREP, Q.DETECTED, body="""SELECT d.symbol, d.ts, pattern, CAST(n.idx - d.idx AS INTEGER) AS "offset", round(CASE WHEN direction = 'BUY' THEN (n.close - d.close) / d.close * 100 ELSE -((n.close - d.close) / d.close * 100) END, 6) + 0.0::DOUBLE AS change, round(n.close - d.close, 6) AS difference
FROM d JOIN b n ON n.symbol = d.symbol AND n.idx BETWEEN d.idx AND d.idx + 10 JOIN (SELECT symbol, max(idx) AS last FROM b GROUP BY symbol) z ON z.symbol = d.symbol AND d.idx + 10 <= z.last WHERE direction <> 'HOLD'"""))
def result_path(spark, sf_dir):
    p = P.prepared(M.bars(spark, sf_dir), "1wk").withColumn("tenth", F.lead("ts", 10).over(I.W()))
    path = F.collect_list("close").over(I.W().rowsBetween(0, 10))
    s = P.detected(p.withColumn("path", path), hold=False).filter("tenth IS NOT NULL").select(*_ID, "close", F.posexplode("path").alias("offset", "c"))
    return s.select("symbol", "ts", "pattern", "offset", (F.round(B.signed(F.col("direction"), (F.col("c") - F.col("close")) / F.col("close") * 100), 6) + 0.0).alias("change"), F.round(F.col("c") - F.col("close"), 6).alias("difference"))


LOOKBACK = 104
_ROUNDED = ("directional_return", "best_move", "worst_move")


@query("historical_scan", S.over(*Q.PREP, Q.DETECTED, FUTURE, INIT, RESOLVE, body=f"""SELECT symbol, "interval", CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, pattern) AS INTEGER) AS place, ts, pattern, direction, close, formation_bars, formation_high, formation_low, trigger, invalidation,
  CASE WHEN evaluation_ts IS NULL THEN 'PENDING' WHEN directional_return >= {MOVE} THEN 'SUCCESS' WHEN directional_return <= -{MOVE} THEN 'FAILURE' ELSE 'INCONCLUSIVE' END AS outcome, CASE WHEN evaluation_ts IS NULL THEN CAST({FWD} - (last - idx) AS INTEGER) END AS remaining,
  evaluation_ts, evaluation_close, round(directional_return, 6) AS directional_return, round(best_move, 6) AS best_move, round(worst_move, 6) AS worst_move, status, resolution_offset, resolution_ts, resolution_close
FROM (SELECT d.symbol, d."interval", d.ts, d.idx, d.pattern, d.direction, d.close, d.size AS formation_bars, d.fh AS formation_high, d.fl AS formation_low, d.trigger, d.invalidation, z.last, exit_ts AS evaluation_ts, exit_close AS evaluation_close,
  CASE WHEN d.direction = 'BUY' THEN (exit_close - d.close) / d.close * 100 ELSE -((exit_close - d.close) / d.close * 100) END AS directional_return,
  CASE WHEN exit_ts IS NULL THEN NULL WHEN d.direction = 'BUY' THEN (max_high - d.close) / d.close * 100 ELSE -((min_low - d.close) / d.close * 100) END AS best_move,
  CASE WHEN exit_ts IS NULL THEN NULL WHEN d.direction = 'BUY' THEN (min_low - d.close) / d.close * 100 ELSE -((max_high - d.close) / d.close * 100) END AS worst_move,
  lr.status, lr.resolution_offset, n.ts AS resolution_ts, n.close AS resolution_close
  FROM li d JOIN fu USING (symbol, ts) JOIN lr ON lr.symbol = d.symbol AND lr.ts = d.ts AND lr.pattern = d.pattern JOIN (SELECT symbol, max(idx) AS last FROM b GROUP BY symbol) z ON z.symbol = d.symbol
  LEFT JOIN b n ON n.symbol = d.symbol AND n.idx = d.idx + lr.resolution_offset WHERE d.idx > z.last - {LOOKBACK})"""))
def historical_scan(spark, sf_dir):
    s = P.detected(B.scan_context(future(spark, sf_dir), LOOKBACK), hold=False)
    return B.historical_scan(s, LOOKBACK, FWD, MOVE).withColumns({c: F.round(c, 6) for c in _ROUNDED})


# Bootstraps: draw d of replicate r on an axis is cluster md5(seed:r:axis:d) mod n
REPLICATES = 1000
_DRAW = "CAST(('0x' || substr(md5('0:' || r || ':{axis}:' || d), 1, 8)) AS BIGINT) % n"


def drawn_sql(name: str, axis: int, clusters: str) -> str:
    return f"""{name} AS (SELECT r, place, count(*) AS w FROM (SELECT r, {_DRAW.format(axis=axis)} AS place FROM (SELECT r, n, unnest(range(1, n + 1)) AS d FROM (SELECT unnest(range(1, {REPLICATES + 1})) AS r), (SELECT count(*) AS n FROM {clusters}))) GROUP BY ALL)"""


@query("cluster_bootstrap", ora("""SELECT CAST(ts AS BIGINT) AS s, CAST(tf AS BIGINT) AS f, ts * 100.0::DOUBLE / nullif(ts + tf, 0) AS precision, CASE WHEN fine THEN low END AS low, CASE WHEN fine THEN high END AS high, replicates
  FROM (SELECT *, ts + tf >= 30 AND replicates >= 950 AS fine FROM (SELECT quantile_cont(p, 0.025) AS low, quantile_cont(p, 0.975) AS high, count(*) AS replicates FROM bp), (SELECT sum(s) AS ts, sum(f) AS tf FROM bc))""",
    "ba AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS place FROM (SELECT DISTINCT symbol FROM tr))", "by_ AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS place FROM (SELECT DISTINCT year(ts) AS y FROM tr))",
    "bc AS (SELECT symbol, year(ts) AS y, count(*) FILTER (outcome = 'SUCCESS') AS s, count(*) FILTER (outcome = 'FAILURE') AS f FROM tr GROUP BY ALL)", drawn_sql("wa", 0, "ba"), drawn_sql("wy", 1, "by_"),
    "bp AS (SELECT s * 100.0::DOUBLE / (s + f) AS p FROM (SELECT wa.r, sum(wa.w * wy.w * bc.s) AS s, sum(wa.w * wy.w * bc.f) AS f FROM bc JOIN ba USING (symbol) JOIN by_ USING (y) JOIN wa ON wa.place = ba.place JOIN wy ON wy.place = by_.place AND wy.r = wa.r GROUP BY wa.r) WHERE s + f > 0)"))
def cluster_bootstrap(spark, sf_dir):
    return BS.cluster_bootstrap(weekly_trades(spark, sf_dir).withColumn("year", F.year("ts")), REPLICATES)


# signal by signal: the first candidate in order that isn't taken
MATCHED = """mf AS (SELECT y.symbol, y.idx, t.* FROM y, LATERAL (SELECT unnest([1, 2, 3]) AS size, unnest([trend_1, trend_2, trend_3]) AS trend, unnest([trend_points_1, trend_points_2, trend_points_3]) AS points) t
  WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.direction <> 'HOLD' AND d.symbol = y.symbol AND d.idx = y.idx)),
ms AS (SELECT symbol, pattern, size, idx, CASE size WHEN 1 THEN trend_1 WHEN 2 THEN trend_2 ELSE trend_3 END AS trend, CASE size WHEN 1 THEN trend_points_1 WHEN 2 THEN trend_points_2 ELSE trend_points_3 END AS points FROM d WHERE direction <> 'HOLD'),
mc AS MATERIALIZED (SELECT symbol, pattern, idx, row_number() OVER (PARTITION BY symbol, pattern ORDER BY idx) AS k, list({'gap': gap, 'distance': distance, 'at': control} ORDER BY gap, distance, control) AS c FROM (
  SELECT ms.symbol, ms.pattern, ms.idx, mf.idx AS control, abs(ms.points - mf.points) AS gap, abs(ms.idx - mf.idx) AS distance FROM ms JOIN mf ON mf.symbol = ms.symbol AND mf.size = ms.size AND mf.trend = ms.trend AND mf.idx BETWEEN ms.idx - 63 AND ms.idx + 63) GROUP BY symbol, pattern, idx),
mg AS (SELECT symbol, pattern, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS idx, []::BIGINT[] AS used, CAST(NULL AS STRUCT(gap BIGINT, distance BIGINT, "at" BIGINT)) AS m FROM (SELECT DISTINCT symbol, pattern FROM mc) UNION ALL
  SELECT symbol, pattern, k, idx, CASE WHEN m IS NULL THEN used ELSE list_append(used, m.at) END, m FROM (
    SELECT mc.symbol, mc.pattern, mc.k, CAST(mc.idx AS BIGINT) AS idx, mg.used, CAST(list_filter(mc.c, lambda x: NOT list_contains(mg.used, x.at))[1] AS STRUCT(gap BIGINT, distance BIGINT, "at" BIGINT)) AS m FROM mg JOIN mc ON mc.symbol = mg.symbol AND mc.pattern = mg.pattern AND mc.k = mg.k + 1)),
mm AS (SELECT symbol, pattern, idx, m.at AS control_idx, m.gap AS gap, m.distance AS distance FROM mg WHERE m IS NOT NULL)"""


@query("matched_controls", ora("SELECT * FROM mm", MATCHED))
def matched_controls(spark, sf_dir):
    p = written(P.prepared(M.bars(spark, sf_dir), "1wk"), "bars")
    return MC.matched_controls(p, P.detected(p, hold=False))


PAIRS = f"""pr AS (SELECT mm.symbol, (a.exit_close - x.close) / x.close * 100.0::DOUBLE * sg AS sr, (b.exit_close - y2.close) / y2.close * 100.0::DOUBLE * sg AS cr FROM mm
  JOIN (SELECT symbol, pattern, idx, ts, close, CASE WHEN direction = 'BUY' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg FROM d WHERE direction <> 'HOLD') x USING (symbol, pattern, idx) JOIN b y2 ON y2.symbol = mm.symbol AND y2.idx = mm.control_idx
  JOIN fu a ON a.symbol = mm.symbol AND a.ts = x.ts JOIN fu b ON b.symbol = mm.symbol AND b.ts = y2.ts WHERE a.exit_close IS NOT NULL AND b.exit_close IS NOT NULL),
pc AS (SELECT symbol, count(*) AS n, sum(sr - cr) AS d, count(*) FILTER (sr >= {MOVE}) AS ss, count(*) FILTER (sr <= -{MOVE}) AS sf, count(*) FILTER (cr >= {MOVE}) AS cs, count(*) FILTER (cr <= -{MOVE}) AS cf FROM pr GROUP BY symbol),
pa AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS place FROM pc)"""
_UPLIFT = "d / n AS uplift, ss * 100.0::DOUBLE / nullif(ss + sf, 0) - cs * 100.0::DOUBLE / nullif(cs + cf, 0) AS precision"
_ENDS = ", ".join(f"list_sort(list({c}) FILTER ({c} IS NOT NULL))[CAST(floor((count({c}) - 1) * 0.025::DOUBLE) AS BIGINT) + 1] AS {c}_low, list_sort(list({c}) FILTER ({c} IS NOT NULL))[CAST(ceil((count({c}) - 1) * 0.975::DOUBLE) AS BIGINT) + 1] AS {c}_high, count({c}) AS {c}_replicates" for c in ("uplift", "precision"))
_PAIRED = ["uplift", "precision", "uplift_low", "uplift_high", "precision_low", "precision_high"]


@query("paired_bootstrap", ora(f"SELECT pairs, {', '.join(f'round({c}, 6) AS {c}' for c in _PAIRED)}, uplift_replicates, precision_replicates FROM (SELECT CAST(n AS BIGINT) AS pairs, {_UPLIFT} FROM (SELECT sum(n) AS n, sum(d) AS d, sum(ss) AS ss, sum(sf) AS sf, sum(cs) AS cs, sum(cf) AS cf FROM pc)), (SELECT {_ENDS} FROM pb)",
    MATCHED, PAIRS, drawn_sql("wp", 0, "pa"), f"pb AS (SELECT {_UPLIFT} FROM (SELECT r, sum(w * n) AS n, sum(w * d) AS d, sum(w * ss) AS ss, sum(w * sf) AS sf, sum(w * cs) AS cs, sum(w * cf) AS cf FROM pc JOIN pa USING (symbol) JOIN wp USING (place) GROUP BY r))"))
def paired_bootstrap(spark, sf_dir):
    """Signals' returns and outcomes on their side, beside those of a position of the same side at the control."""
    p = written(future(spark, sf_dir), "bars")
    s = P.detected(p, hold=False)
    sign = F.when(F.col("direction") == "BUY", 1.0).otherwise(-1.0)
    moves = p.select("symbol", F.col("idx").cast("long").alias("idx"), ((F.col("exit_close") - F.col("close")) / F.col("close") * 100.0).alias("r")).filter("r IS NOT NULL")
    m = MC.matched_controls(p, s).join(s.select("symbol", "pattern", F.col("idx").cast("long").alias("idx"), sign.alias("sign")), ["symbol", "pattern", "idx"])
    pairs = m.join(moves.withColumnRenamed("r", "a"), ["symbol", "idx"]).join(moves.withColumnsRenamed({"r": "b", "idx": "control_idx"}), ["symbol", "control_idx"])
    pairs = pairs.select("symbol", (F.col("a") * F.col("sign")).alias("signal_return"), (F.col("b") * F.col("sign")).alias("control_return"))
    out = BS.paired_bootstrap(pairs.withColumns({"signal_outcome": B.outcome(F.col("signal_return"), MOVE), "control_outcome": B.outcome(F.col("control_return"), MOVE)}), REPLICATES)
    return out.withColumns({c: F.round(c, 6) for c in _PAIRED})


for _to, _label in (("1wk", "first"), ("1mo", "last")):
    _unit = {"1wk": "week", "1mo": "month"}[_to]

    @query(f"resample_bars_{_to}", S.over(S.TICKS, S.bars("1d", "day"), body=f"""SELECT symbol, '{_to}' AS "interval", {'min' if _label == 'first' else 'max'}(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM day GROUP BY symbol, date_trunc('{_unit}', ts)"""))
    def _resample(spark, sf_dir, to=_to, label=_label):
        return B.resampled(M.bars(spark, sf_dir, "1d"), to, label)


@query("bars_in_window", S.over(S.TICKS, S.bars(), body="SELECT symbol, \"interval\", count(*) AS n FROM bars WHERE ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-01-01' GROUP BY ALL"))
def bars_in_window(spark, sf_dir):
    return M.bars(spark, sf_dir).filter("ts >= '1997-01-01' AND ts < '1998-01-01'").groupBy("symbol", "interval").agg(F.count("*").alias("n"))


@query("scan_profile", S.over(S.TICKS, S.bars(), body="SELECT symbol, \"interval\", 104 AS lookback, 4 AS forward, 4.0::DOUBLE AS move, count(*) AS held FROM bars GROUP BY ALL"))
def scan_profile(spark, sf_dir):
    dim = spark.createDataFrame([("1d", 60, 10, 3.0), ("1wk", 104, 4, 4.0), ("1mo", 120, 3, 6.0)], "interval string, lookback int, forward int, move double")
    return M.bars(spark, sf_dir).groupBy("symbol", "interval").agg(F.count("*").alias("held")).join(F.broadcast(dim), "interval").select("symbol", "interval", "lookback", "forward", "move", "held")


@query("executable_timing", S.over(*Q.PREP, Q.DETECTED, body=f"""SELECT d.symbol, d.ts, pattern, entry_ts, entry, round(CASE WHEN direction = 'BUY' THEN (x - entry) / entry * 100 ELSE -((x - entry) / entry * 100) END, 6) + 0.0::DOUBLE AS change,
  round(CASE WHEN direction = 'BUY' THEN mx - entry ELSE entry - mn END / entry * 100, 6) AS mfe, round(CASE WHEN direction = 'BUY' THEN mn - entry ELSE entry - mx END / entry * 100, 6) AS mae
FROM d JOIN (SELECT symbol, ts, lead(ts) OVER w AS entry_ts, lead(open) OVER w AS entry, lead(close, {FWD}) OVER w AS x, max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND {FWD} FOLLOWING) AS mx, min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND {FWD} FOLLOWING) AS mn FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts)) f ON f.symbol = d.symbol AND f.ts = d.ts
WHERE direction <> 'HOLD' AND x IS NOT NULL"""))
def executable_timing(spark, sf_dir):
    p = future(spark, sf_dir).withColumns({"entry_ts": F.lead("ts").over(I.W()), "entry": F.lead("open").over(I.W())})
    s, e, buy = P.detected(p, hold=False).filter("exit_close IS NOT NULL"), F.col("entry"), F.col("direction") == "BUY"
    change = F.round(B.signed(F.col("direction"), (F.col("exit_close") - e) / e * 100), 6) + 0.0
    mfe, mae = F.when(buy, F.col("max_high") - e).otherwise(e - F.col("min_low")), F.when(buy, F.col("min_low") - e).otherwise(e - F.col("max_high"))
    return s.select("symbol", "ts", "pattern", "entry_ts", "entry", change.alias("change"), F.round(mfe / e * 100, 6).alias("mfe"), F.round(mae / e * 100, 6).alias("mae"))
