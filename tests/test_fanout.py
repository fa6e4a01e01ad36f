"""Fan-out of trades to followers: pairs are made last, of blocks of followers."""

from __future__ import annotations

import datetime
import random

import pytest

from tidemark.operators import matching as J
from tidemark.streaming import streams as T

DAY = datetime.date(2020, 1, 1)
SUBSCRIPTIONS = "user_id long, symbol string, active boolean, activated date, baseline date, segment long"
TRADES = "trade_id long, symbol string, first_seen date, disclosed date"


def tables(seed: int, users: int = 80, trades: int = 60):
    r = random.Random(seed)
    day = lambda: DAY + datetime.timedelta(days=r.randint(0, 40))
    subs = [(u, r.choice("abc"), r.random() < 0.8, day(), r.choice([day(), day(), None]), u % 3) for u in range(users)]
    return subs, [(t, r.choice(["a", "b", "c", "d", None]), day(), day()) for t in range(trades)]


def due(subs, trades):
    return {(t[0], s[0]) for t in trades for s in subs if s[1] == t[1] and s[2] and s[4] and t[2] >= s[4] and t[3] >= s[3]}


@pytest.mark.parametrize("block", [4096, 5])
def test_delivered_segments_and_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(J, "AUDIENCE", block)
    subs, trades = tables(1)
    s, t = spark.createDataFrame(subs, SUBSCRIPTIONS), spark.createDataFrame(trades, TRADES)
    sent = [(k, seg) for k in range(0, 60, 2) for seg in (0, 2)]
    gone = {(k, u[0]) for k, seg in sent for u in subs if u[5] == seg}
    by_segment = spark.createDataFrame(sent, "trade_id long, segment long")
    by_pair = spark.createDataFrame(sorted(gone), "trade_id long, user_id long")
    want = sorted(due(subs, trades) - gone)
    every = sorted({(x[0], u[0]) for x in trades for u in subs if u[1] == x[1] and u[2] and u[4]} - gone)
    for done in (by_segment, by_pair):
        assert sorted(map(tuple, J.congress_fanout(t, s, done).collect())) == want
        assert sorted(map(tuple, J.insider_fanout(t, s, done).collect())) == every


def test_pairs_are_not_shuffled(spark):
    subs, trades = tables(2)
    s, t = spark.createDataFrame(subs, SUBSCRIPTIONS), spark.createDataFrame(trades, TRADES)
    done = spark.createDataFrame([(1, 0)], "trade_id long, segment long")
    for job in (J.congress_fanout, J.insider_fanout):
        plan = job(t, s, done)._jdf.queryExecution().executedPlan().toString()
        above = plan.split("Generate explode(")[0]
        assert "Generate explode(" in plan and "Exchange" not in above and "Join" not in above


def test_stream_log_of_changing_audiences(spark, tmp_path):
    """Batches come twice, trades again, subscriptions change between batches; each delivery is made once,
    by the first batch that was due, and trades that come again alike aren't logged again."""
    path, want = str(tmp_path / "log"), {}
    subs, trades = tables(3)
    other = [(u, s, not a if u % 7 == 0 else a, x, b, g) for u, s, a, x, b, g in subs]
    for epoch, (people, ids) in enumerate([(subs, range(0, 30)), (subs, range(20, 40)), (other, range(10, 50)), (subs, range(0, 60))]):
        batch = [x for x in trades if x[0] in ids]
        for pair in due(people, batch):
            want.setdefault(pair, epoch)
        write = T.fanout_batches(path, spark.createDataFrame(people, SUBSCRIPTIONS))
        for _ in range(1 + (epoch % 2)):
            write(spark.createDataFrame(batch + batch[:3], TRADES), epoch)
        if epoch == 1:
            assert spark.read.parquet(f"{path}/trades").count() == len([x for x in trades[:40] if x[1]])
    assert {(r.trade_id, r.user_id): r.epoch for r in T.delivered(spark, path).collect()} == want
    assert T.delivered(spark, path).count() == len(want)


def test_files_of_pairs_are_small(spark, tmp_path):
    """A block of followers meets one trade after the other, so that ids recur in runs and in one order."""
    subs = [(u * 7919 % 100003, "a", True, DAY, DAY, u % 2) for u in range(6000)]
    trades = [(t * 104729 % 1000003, "a", DAY, DAY) for t in range(480)]
    s, t = spark.createDataFrame(subs, SUBSCRIPTIONS), spark.createDataFrame(trades, TRADES)
    done = spark.createDataFrame([(trades[0][0], 0)], "trade_id long, segment long")
    for k, job in enumerate((J.congress_fanout, J.insider_fanout)):
        job(t, s, done).write.parquet(f"{tmp_path}/{k}")
        size = sum(f.stat().st_size for f in (tmp_path / str(k)).glob("*.parquet"))
        assert spark.read.parquet(f"{tmp_path}/{k}").count() == 6000 * 480 - 3000
        assert size < 0.5 * (6000 * 480 - 3000)


def test_pairs_are_made_after_the_join(spark):
    """Compiled into one step with the join, all pairs of a row of its left side would be held before any is written."""
    subs, trades = tables(4)
    s, t = spark.createDataFrame(subs, SUBSCRIPTIONS), spark.createDataFrame(trades, TRADES)
    for job in (J.congress_fanout, J.insider_fanout):
        df = job(t, s, spark.createDataFrame([(1, 0)], "trade_id long, segment long"))
        df.collect()
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        assert "*(" in next(x for x in lines if "Generate explode(users" in x)
        assert "*(" not in next(x for x in lines if "SortMergeJoin" in x)


def test_followers_without_segment(spark):
    """A follower who is in no segment has no trade from a segment's delivery."""
    s = spark.createDataFrame([(1, "a", True, DAY, DAY, 0), (2, "a", True, DAY, DAY, None)], SUBSCRIPTIONS)
    t = spark.createDataFrame([(5, "a", DAY, DAY)], TRADES)
    done = spark.createDataFrame([(5, 0)], "trade_id long, segment long")
    for job in (J.congress_fanout, J.insider_fanout):
        assert [tuple(x) for x in job(t, s, done).collect()] == [(5, 2)]


def test_logs_of_all_audiences_meet_before_pairs(spark, tmp_path):
    """When subscriptions change, all trades that come again are logged again: their pairs aren't shuffled to find the
    first delivery, but for a trade that comes with another symbol."""
    subs, trades = tables(5, 400)
    subs += [(u, "abc"[("abc".index(s) + 1) % 3], a, x, b, g) for u, s, a, x, b, g in subs if u % 2]
    other = [(u, s, not a if u % 7 == 0 else a, x, b, g) for u, s, a, x, b, g in subs]
    moved = [(*trades[k][:1], "b" if trades[k][1] == "a" else "a", *trades[k][2:]) if k in (4, 5, 6) else trades[k] for k in range(60)]
    want, path = {}, str(tmp_path / "log")
    for epoch, (people, batch) in enumerate([(subs, trades), (other, trades), (subs, moved)]):
        for pair in due(people, batch):
            want.setdefault(pair, epoch)
        T.fanout_batches(path, spark.createDataFrame(people, SUBSCRIPTIONS))(spark.createDataFrame(batch, TRADES), epoch)
    df = T.delivered(spark, path)
    rows = df.collect()
    assert {(r.trade_id, r.user_id): r.epoch for r in rows} == want and len(rows) == len(want)
    read, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:  # rows that go into the grouping of pairs
        node = nodes.pop()
        inner = {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "ResultQueryStage": "plan"}.get(node.nodeName())
        if inner:
            nodes.append(getattr(node, inner)())
            continue
        nodes += [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Exchange" and "hashpartitioning(trade_id" in node.toString().split("\n")[0] and "user_id" in node.toString().split("\n")[0]:
            read += node.metrics().apply("shuffleRecordsWritten").value()
    assert read <= sum(len(due(p, [x for x in b if x[0] in (4, 5, 6)])) for p, b in ((subs, trades), (other, trades), (subs, moved)))


def test_files_of_insider_pairs_are_small(spark, tmp_path):
    """As above with the insiders' ids, which are texts, and one segment of two that is delivered."""
    s = spark.createDataFrame([(u * 7919 % 100003, "a", True, DAY, DAY, u % 2) for u in range(12000)], SUBSCRIPTIONS)
    t = spark.createDataFrame([(f"{k * 104729 % 1000003}-{k % 7}-{k * 31}-{k * 17}-{k}", "a") for k in range(480)], "trade_id string, symbol string")
    done = t.selectExpr("trade_id", "0L AS segment")
    J.insider_fanout(t, s, done).write.parquet(f"{tmp_path}/pairs")
    out = spark.read.parquet(f"{tmp_path}/pairs")
    assert out.distinct().count() == out.count() == 6000 * 480
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * 6000 * 480
