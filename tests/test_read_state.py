"""Events' read state, boards over it, and wave rules, against plain loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from tidemark.operators import elliott as L
from tidemark.operators import matching as J

T0 = datetime(2020, 1, 1)
EVENTS = "rule_id long, user_id long, symbol string, sent_at timestamp, pattern string, read_at string"


def made(seed):
    r = random.Random(seed)
    day = lambda: T0 + timedelta(days=r.randint(0, 20))
    user = lambda: r.choice([1, 1, 1, 2, None])
    events = [(k % 7, user(), r.choice(["A", "B", None]), r.choice([day(), day(), None]), r.choice("xyz"), "clash") for k in range(120)]
    reads = [(user(), r.choice(["A", "B", None]), r.choice([day(), day(), None])) for _ in range(25)]
    return events, reads + reads[:5]


def test_read_state_is_the_first_opening_since(spark):
    events, reads = made(5)
    df = spark.createDataFrame(events, EVENTS).drop("read_at")
    marks = spark.createDataFrame(reads, "user_id long, symbol string, read_at timestamp")
    want = []
    for rule, user, symbol, at, pattern, _ in events:
        later = [t for u, s, t in reads if None not in (user, symbol, at, u, s, t) and (u, s) == (user, symbol) and t >= at]
        want.append((rule, user, symbol, at, pattern, min(later) if later else None))
    got = J.with_read(df, marks)
    assert got.columns == ["user_id", "symbol", "sent_at", "rule_id", "pattern", "read_at"]
    key = lambda x: tuple(map(str, x))
    assert sorted(((x.rule_id, x.user_id, x.symbol, x.sent_at, x.pattern, x.read_at) for x in got.collect()), key=key) == sorted(want, key=key)
    assert any(x[-1] for x in want) and not J.with_read(df.limit(0), marks).count()
    assert {x.read_at for x in J.with_read(df, marks.limit(0)).collect()} == {None}


def test_board_and_newest_signals(spark):
    rules = spark.createDataFrame([(0, 1, "A", "1d", "BUY", "CANDLESTICK", True), (1, 1, "A", "1wk", "SELL", "ELLIOTT", False), (2, 2, "A", "1d", "BUY", "CANDLESTICK", True), (3, 2, "B", "1d", "BUY", "ELLIOTT", True)], "rule_id long, user_id long, symbol string, interval string, side string, family string, active boolean")
    at = lambda n: T0 + timedelta(days=n)
    events = spark.createDataFrame(
        [(0, 1, "A", at(1), "x", None), (0, 1, "A", at(1), "w", None), (0, 1, "A", at(3), "x", at(4)), (1, 1, "A", at(9), "x", None), (2, 2, "A", at(2), "x", None), (2, 2, "A", at(5), "x", None), (2, 2, "A", at(6), "x", None)],
        "rule_id long, user_id long, symbol string, sent_at timestamp, pattern string, read_at timestamp",
    )
    board = {x.symbol: x for x in J.company_board(rules, events).collect()}
    assert tuple(board["A"]) == ("A", 3, 2, "1d,1wk", "CANDLESTICK,ELLIOTT", "BUY,SELL", 5)
    assert tuple(board["B"]) == ("B", 1, 1, "1d", "ELLIOTT", "BUY", 0)
    got = [(x.user_id, x.place, x.sent_at, x.pattern) for x in J.latest_signals(rules, events, 2).orderBy("user_id", "place").collect()]
    assert got == [(1, 1, at(1), "w"), (1, 2, at(1), "x"), (2, 1, at(6), "x"), (2, 2, at(5), "x")]
    assert J.company_board(rules, events.limit(0)).agg({"unread": "sum"}).first()[0] == 0


def test_wave_rules_match_a_cycle_and_stage_once(spark):
    at = lambda n: T0 + timedelta(days=n)
    signals = spark.createDataFrame(
        [("A", "1wk", "BUY", "k1", "V", at(5), "late"), ("A", "1wk", "BUY", "k1", "V", at(3), "first"), ("A", "1wk", "BUY", "k1", "C", at(6), "other"), ("A", "1wk", "SELL", "k2", "V", at(3), "s"), ("A", "1wk", "BUY", None, "V", at(1), "none"), ("B", "1wk", "BUY", "k1", "V", at(3), "b")],
        "symbol string, interval string, direction string, cycle_key string, stage string, ts timestamp, pattern string",
    )
    rules = spark.createDataFrame([(1, 1, "A", "1wk", "BUY", "ELLIOTT", True), (2, 2, "A", "1wk", "BUY", "ELLIOTT", False), (3, 3, "A", "1wk", "BUY", "CANDLESTICK", True), (4, 4, "A", "1wk", "BUY", "ELLIOTT", True), (5, 5, "A", "1d", "BUY", "ELLIOTT", True)], "rule_id long, user_id long, symbol string, interval string, side string, family string, active boolean")
    recorded = spark.createDataFrame([(4, "k1", "V"), (9, "k1", "C")], "rule_id long, cycle_key string, stage string")
    got = sorted((x.rule_id, x.cycle_key, x.stage, x.ts, x.pattern) for x in J.match_wave_rules(signals, rules, recorded).collect())
    assert got == [(1, "k1", "C", at(6), "other"), (1, "k1", "V", at(3), "first"), (4, "k1", "C", at(6), "other")]
    assert J.match_wave_rules(signals.limit(0), rules, recorded).count() == 0


def test_variant_that_a_pattern_asks_for(spark):
    names = {"ELLIOTT_BULLISH_WAVE_V_END": "FULL", "ELLIOTT_BEARISH_TRUNCATED_WAVE_V_END": "TRUNCATED", "ELLIOTT_BULLISH_CORRECTION": "STANDARD", "ELLIOTT_BEARISH_EXPANDED_FLAT_CORRECTION": "EXPANDED_FLAT", "ELLIOTT_BULLISH_RUNNING_FLAT_CORRECTION": "RUNNING_FLAT"}
    df = spark.createDataFrame([(k,) for k in names], "pattern string")
    assert {x.pattern: x.variant for x in df.withColumn("variant", L.variant_of(df.pattern)).collect()} == names
