"""Streams against their batch twins."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from tidemark.operators import waves as V
from tidemark.plans import elliott, live
from tidemark.streaming import streams as T

SF = "/root/testdata/sf0.001"


def test_rate_window_stream_equals_batch(spark):
    a, b = live.rate_window(spark, SF), live.stream_rate_window(spark, SF)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def epoch(day: float):
    return datetime.datetime(2020, 1, 1) + datetime.timedelta(days=day)


CLOSES = "event_id string, kind string, side string, trigger double, invalidation double, ts timestamp, close double"


def test_lifecycle_stream_with_revisions_equals_batch(spark):
    """Revisions reset boundaries and count; rows that come late but in time; long idle events."""
    r, rows = random.Random(5), []
    for k in range(60):
        at, side = r.randint(0, 200), r.choice(["BUY", "SELL"])
        for _ in range(r.randint(1, 7)):
            at += r.randint(1, 8)
            kind = "REVISE" if r.random() < 0.25 else "CLOSE"
            rows.append((f"e{k}", kind, side, 10.0 + r.randint(-1, 1), 9.0, epoch(at), 9.5 + r.randint(-2, 2) * 0.5))
    df = spark.createDataFrame(rows, CLOSES)
    want = sorted(map(tuple, T.lifecycle_batch(df, 3).collect()))
    got = live.replayed(spark, df, lambda x: T.lifecycle_stream(x, 3), parts=7)
    assert sorted(map(tuple, got.select("event_id", "status", "seen", "ts").collect())) == want
    assert {x[1] for x in want} == {"CONFIRMED", "INVALIDATED", "EXPIRED"}


def test_revision_counts_anew(spark):
    rows = [("a", "CLOSE", "BUY", 10.0, 5.0, epoch(1), 9.0), ("a", "CLOSE", "BUY", 10.0, 5.0, epoch(2), 9.0), ("a", "REVISE", "BUY", 20.0, 8.5, epoch(3), 0.0), ("a", "REVISE", "BUY", 1.0, 0.5, epoch(2), 0.0), ("a", "CLOSE", "BUY", 10.0, 5.0, epoch(3), 30.0), ("a", "CLOSE", "BUY", 10.0, 5.0, epoch(4), 15.0), ("a", "CLOSE", "BUY", 10.0, 5.0, epoch(5), 8.0)]
    assert [tuple(x) for x in T.lifecycle_batch(spark.createDataFrame(rows, CLOSES), 3).collect()] == [("a", "INVALIDATED", 2, epoch(5))]


def state_rows(spark, rows, job, parts):
    """Keys in the state after each step of a stream."""
    at, out = live._dir(spark), []
    for stream in live.arrivals(spark, rows, at, parts):
        q = job(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        out.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    return out


def test_idle_keys_leave_the_state(spark):
    """Keys of one day each, and one that stays: the state holds few of 90."""
    rows = [(day, day, epoch(day)) for day in range(90)] + [(1000, day, epoch(day + 0.5)) for day in range(90)]
    df = spark.createDataFrame(rows, "key long, id long, ts timestamp")
    assert max(state_rows(spark, df, lambda s: T.rate_window_stream(s, 2, 3600), 6)[1:]) <= 20
    closes = spark.createDataFrame([(f"e{d}", "CLOSE", "BUY", 10.0, 5.0, epoch(d), 9.0) for d in range(90)], CLOSES)
    assert state_rows(spark, closes, lambda s: T.lifecycle_stream(s, 3, "1 day", 86400), 6)[-1] <= 20


def bar_rows(spark, rows):
    return spark.createDataFrame(rows, "symbol string, interval string, ts timestamp, open double, high double, low double, close double, volume long, arrival timestamp")


def test_bar_store_reads_touched_months_and_repeats_nothing(spark, tmp_path):
    bar = lambda s, day, close, arrival: (s, "1d", epoch(day), 1.0, 9.0, 0.5, close, 10, epoch(arrival))
    path, r, held = str(tmp_path / "store"), random.Random(1), {}
    write = T.upsert_batches(path, "arrival", every=3)
    for k in range(8):
        rows = [bar(s, 30 * k + r.randint(-35, 20), float(r.randint(1, 3)), 1000 + k) for s in "ab" for _ in range(6)]
        rows = list({x[:3]: x for x in rows}.values())
        held |= {x[:3]: x[6] for x in rows}
        for _ in range(1 + (k in (3, 5))):  # some batches come twice
            write(bar_rows(spark, rows), k)
    schema = bar_rows(spark, []).schema
    got = {(x.symbol, x.interval, x.ts): x.close for x in T.upserted(spark, path, schema).collect()}
    assert got == held
    store = T.bar_store(path, schema)
    touched = store.rows(spark, None, spark.createDataFrame([("2020-03",)], "month string"))
    scans = [x for x in touched._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x]
    assert len(scans) == 2 and all("(month" in x.split("PartitionFilters: ")[1].split("]")[0] for x in scans)
    assert {x.month for x in touched.select("month").distinct().collect()} == {"2020-03"}
    assert any("snapshots/until=6" in f for f in store.rows(spark).inputFiles())


def test_seen_store_keeps_first_and_last(spark, tmp_path):
    path, r, held = str(tmp_path / "seen"), random.Random(2), {}
    write = T.seen_batches(path, every=2)
    for k in range(5):
        rows = [(f"{r.randint(0, 20):02x}", epoch(r.randint(0, 300))) for _ in range(30)]
        for f, ts in rows:
            a, b = held.get(f, (ts, ts))
            held[f] = (min(a, ts), max(b, ts))
        for _ in range(1 + (k == 2)):
            write(spark.createDataFrame(rows, "fingerprint string, ts timestamp"), k)
    assert {x.fingerprint: (x.first_seen, x.last_seen) for x in T.seen(spark, path).collect()} == held


def test_replay_sees_nothing_later(spark):
    rows = [(s, "1d", epoch(d), 1.0, 9.0, 0.5, float(d), 10, epoch(d)) for s, days in (("a", range(0, 40)), ("b", range(20, 30, 3))) for d in days]
    runs = spark.createDataFrame([(epoch(14),)], "scheduled_for timestamp")
    got = T.point_in_time_replay(bar_rows(spark, rows), runs, "2020-01-01", "2020-02-12", 3)
    want = []
    for d in range(0, 43, 7):
        for s in "ab":
            want += [(s, epoch(d), x[2]) for x in sorted(x for x in rows if x[0] == s and x[2] < epoch(d))[-3:] if d != 14]
    assert sorted((x.symbol, x.scheduled_for, x.ts) for x in got.collect()) == sorted(want)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_pivots_alternate_and_turn_far_enough(spark):
    rows = elliott.zigzag_pivots(spark, SF).orderBy("symbol", "sensitivity", "seq").collect()
    assert rows
    for a, b in zip(rows, rows[1:], strict=False):
        if (a.symbol, a.sensitivity) == (b.symbol, b.sensitivity):
            assert a.kind != b.kind and a.idx < b.idx
            assert (b.price > a.price) == (b.kind == "HIGH")


def test_chosen_structures_do_not_overlap(spark):
    s = V.historical_structures(elliott.counted(spark, SF)).collect()
    for a in s:
        for b in s:
            if a is not b and a.symbol == b.symbol:
                shared = min(a.end_idx, b.end_idx) - max(a.start_idx, b.start_idx)
                assert shared <= 0.4 * min(a.end_idx - a.start_idx, b.end_idx - b.start_idx)


def test_anchored_profile_keeps_the_volume(spark):
    from tidemark.operators import matching as J
    from tidemark.sources import market as M

    b = M.bars(spark, SF)
    p = J.anchored_bins(b, b.select("symbol").distinct().withColumn("anchor", F.lit("1990-01-01").cast("timestamp")))
    kept = {r.symbol: r.v for r in p.groupBy("symbol").agg(F.sum("volume").alias("v")).collect()}
    for r in b.groupBy("symbol").agg(F.sum("volume").alias("v")).collect():
        assert abs(kept[r.symbol] - r.v) < 1e-6 * r.v
