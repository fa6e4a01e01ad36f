"""Alerts, profile selection and CSV files on small fixtures: the cases that the tables lack."""

from __future__ import annotations

import datetime
import gzip

from pyspark.sql import functions as F

from tidemark.operators import alerts as A
from tidemark.operators import profile as V
from tidemark.sources import files

BARS = "symbol string, interval string, ts timestamp, open double, high double, low double, close double, volume bigint"


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def bar(symbol, interval, ts, close, volume=10):
    return (symbol, interval, ts, close, close + 1.0, close - 1.0, close, volume)


def test_calibration_points(spark):
    rows = [("A", "1wk", "HAMMER"), ("A", "1mo", "HAMMER"), ("A", "1mo", "PIERCING_LINE"), ("A", "1d", "HAMMER"), ("A", "1wk", "EVENING_STAR"), (None, None, None)]
    df = spark.createDataFrame(rows, "symbol string, interval string, pattern string")
    got = {(r.interval, r.pattern): r.points for r in A.calibration_points(df).collect()}
    assert got == {("1wk", "HAMMER"): 10, ("1mo", "HAMMER"): 8, ("1mo", "PIERCING_LINE"): 5, ("1d", "HAMMER"): 5, ("1wk", "EVENING_STAR"): 0, (None, None): 5}
    few = spark.createDataFrame([("1wk", "HAMMER", 20, 9, 99.0)], "interval string, pattern string, sample int, decided int, precision double")
    assert {r.points for r in A.calibration_points(df, few).collect()} == {5}
    edges = [(x, x) for x in (70.0, 69.9, 65.0, 60.0, 55.0, 54.9, 45.0, 35.0, 30.0, 25.0, 24.9)]
    held = spark.createDataFrame([("1wk", str(i), 20, 10, p) for i, (p, _) in enumerate(edges)], few.schema)
    s = spark.createDataFrame([("A", "1wk", str(i)) for i in range(len(edges))], df.schema)
    assert [r.points for r in A.calibration_points(s, held).orderBy(F.desc("precision")).collect()] == [10, 9, 9, 8, 7, 5, 5, 3, 2, 1, 0]


def test_horizon_guidance(spark):
    rows = [("CANDLESTICK", "1d"), ("ELLIOTT", "1d"), (None, "1mo"), ("CANDLESTICK", "15min"), ("CANDLESTICK", None)]
    df = spark.createDataFrame(rows, "family string, interval string")
    assert [r[0] for r in df.select(A.horizon_guidance(F.col("family"), F.col("interval"))).collect()] == ["10 trading sessions", None, "3, 6, and 9 months", None, None]


EVENTS = "symbol string, interval string, ts timestamp, pattern string, direction string, family string, size int, price double"


def test_observed_outcome(spark):
    closes = [100.0, 102.0, 100.0, 99.0, 101.0, 104.0, 90.0]
    bars = spark.createDataFrame([bar("A", "1wk", day(7 * i), c) for i, c in enumerate(closes)], BARS)
    e = lambda n, p, d, family="CANDLESTICK", size=1, price=100.0: ("A", "1wk", day(7 * n), p, d, family, size, price)
    rows = [e(1, "up", "BUY", size=2), e(2, "down", "SELL"), e(0, "flat", "BUY"), e(4, "open", "SELL"), e(6, "last", "BUY"), e(2, "wave", "BUY", "ELLIOTT"), e(2, "free", "BUY", price=0.0), e(2, "none", "BUY", price=None), e(9, "gone", "BUY"), e(2, "inf", "BUY", price=float("inf"))]
    got = {r.pattern: r for r in A.observed_outcome(spark.createDataFrame(rows, EVENTS), bars, "1wk").collect()}
    assert len(got) == len(rows)
    up, down, flat = got["up"], got["down"], got["flat"]
    assert (up.status, up.change, up.best_move, up.worst_move, up.impact, up.evaluation_ts) == ("SUCCESS", 4.0, 5.0, -2.0, "GAIN", day(35))
    assert (up.pattern_high, up.pattern_low) == (103.0, 99.0)
    assert (down.status, down.change, down.best_move, down.worst_move, down.impact) == ("SUCCESS", 10.0, 11.0, -5.0, "LOSS_AVOIDED")
    assert (flat.status, flat.change, flat.impact) == ("INCONCLUSIVE", 1.0, "GAIN")
    assert [(got[k].status, got[k].missing, got[k].change) for k in ("open", "last")] == [("PENDING", 2, None), ("PENDING", 4, None)]
    assert all((got[k].status, got[k].missing, got[k].pattern_high) == ("UNAVAILABLE", None, None) for k in ("wave", "free", "none", "gone", "inf"))
    assert A.observed_outcome(spark.createDataFrame([], EVENTS), bars, "1wk").count() == 0


def test_signal_excursion(spark):
    closes = [100.0, 105.0, 95.0, 110.0]
    bars = spark.createDataFrame([bar("A", "1wk", day(7 * i), c) for i, c in enumerate(closes)], BARS).withColumn("idx", (F.datediff("ts", F.lit(day(0))) / 7 + 1).cast("int"))
    schema = "symbol string, interval string, ts timestamp, pattern string, direction string, idx int, price double, resolution_offset int"
    rows = [("A", "1wk", day(0), "whole", "BUY", 1, 100.0, None), ("A", "1wk", day(0), "first", "BUY", 1, 100.0, 1), ("A", "1wk", day(0), "sold", "SELL", 1, 100.0, 2), ("A", "1wk", day(21), "last", "BUY", 4, 110.0, None), ("A", "1wk", day(0), "free", "BUY", 1, None, None)]
    got = {r.pattern: (r.seen, r.resolved, r.best_move, r.worst_move) for r in A.signal_excursion(spark.createDataFrame(rows, schema), bars).collect()}
    assert got == {"whole": (3, False, 11.0, -6.0), "first": (1, True, 6.0, 4.0), "sold": (2, True, 6.0, -6.0), "last": (0, False, None, None), "free": (0, False, None, None)}


ANCHORS = "symbol string, want string, anchor timestamp, active timestamp, frozen struct<interval:string,ts:timestamp,open:double,high:double,low:double,close:double,volume:bigint>"


def chosen(spark, *, want="1d", fine=True, anchor=1, frozen=None):
    """(interval, day, quarter hour, volume) of a profile's bars, and what it is calculated from."""
    rows = [bar("A", "1d", day(i), 100.0) for i in range(5)] + [bar("A", "1wk", day(7 * i - 7), 100.0, 50) for i in range(3)]
    if fine:
        rows += [bar("A", "15min", day(i) + datetime.timedelta(minutes=15 * q), 100.0, 3) for i in (3, 4) for q in range(3)]
    active = day(4) if want == "1d" else day(7)
    snap = frozen and (frozen[0], day(frozen[1]) + datetime.timedelta(minutes=15 * frozen[2]), 1.0, 1.0, 1.0, 1.0, 1)
    a = spark.createDataFrame([("A", want, day(anchor), active, snap)], ANCHORS)
    out = V.selected(spark.createDataFrame(rows, BARS), a).collect()
    got = sorted((r.interval, (r.ts - day(0)).days, (r.ts - day(0)).seconds // 900, r.volume) for r in out)
    return got, {r.calculated for r in out}


def test_profile_selection(spark):
    days, quarters = [("1d", i, 0, 10) for i in (1, 2, 3)], [("15min", 4, q, 3) for q in (0, 1, 2)]
    assert chosen(spark) == (quarters + days, {"1d+15min"})
    assert chosen(spark, anchor=4) == (quarters, {"15min"})
    assert chosen(spark, fine=False) == ([*days, ("1d", 4, 0, 10)], {"1d"})
    assert chosen(spark, want="1wk", anchor=0) == ([("1wk", 0, 0, 50), ("1wk", 7, 0, 50)], {"1wk"})


def test_frozen_profiles(spark):
    days = [("1d", i, 0, 10) for i in (1, 2, 3)]
    assert chosen(spark, frozen=("15min", 4, 1)) == ([("15min", 4, 0, 3), ("15min", 4, 1, 1), *days], {"1d+15min"})
    # a snapshot before the active day cuts all of it away
    assert chosen(spark, frozen=("15min", 3, 1)) == (days, {"1d"})
    assert chosen(spark, frozen=("1d", 4, 0)) == ([*days, ("1d", 4, 0, 1)], {"1d"})
    assert chosen(spark, want="1wk", anchor=0, frozen=("1wk", 7, 0)) == ([("1wk", 0, 0, 50), ("1wk", 7, 0, 1)], {"1wk"})
    assert chosen(spark, want="1wk", anchor=0, frozen=("1d", 7, 0)) == ([("1wk", 0, 0, 50)], {"1wk"})


def test_adjusted_csv(spark, tmp_path):
    lines = ["ticker,date,open,high,low,close,volume", "A,2024-01-02,10,11,9,10.5,100", "A,2024-01-03,10,9.99,9,9.5,100", "A,2024-01-04,10,9.9999999999,9,9.5,0", "A,2024-01-05,0,11,0,10,5", "A,later,10,11,9,10,5", "A,2024-01-06,,11,9,10,5", "Z,2024-01-02,10,11,9,10,5"]
    with gzip.open(tmp_path / "prices.csv.gz", "wt") as f:
        f.write("\n".join(lines) + "\n")
    universe = spark.createDataFrame([("A",), ("B",)], "symbol string")
    rows = files.adjusted_csv(spark, str(tmp_path), universe).collect()
    assert {r.symbol for r in rows} == {"A"} and len(rows) == 6
    assert [r.ts for r in sorted((r for r in rows if r.good), key=lambda r: r.ts)] == [datetime.datetime(2024, 1, 2), datetime.datetime(2024, 1, 4)]


def test_rows_through_csv(spark, tmp_path):
    rows = [("b", 2, 0.1, day(1)), ("a", 9, None, day(2)), ("a", 1, 1e-300, day(0)), (None, 3, -0.0, None)]
    df = spark.createDataFrame(rows, "name string, n int, x double, ts timestamp")
    files.write_rows(df, str(tmp_path / "out"), ["name", "n"])
    again = files.read_rows(spark, str(tmp_path / "out"), df)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, df.collect()))
    parts = sorted((tmp_path / "out").glob("part-*.csv"))
    kept = [line.split(",")[0] for p in parts for line in p.read_text().splitlines()[1:]]
    assert kept == ['', "a", "a", "b"] or kept == ['""', "a", "a", "b"]
