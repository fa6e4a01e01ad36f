"""The greedy choice of structures by islands against the plain one over whole symbols."""

from __future__ import annotations

import random

from tidemark.operators import waves as V


def plain(rows, overlap=0.4):
    best = {}
    for x in rows:
        k = (x["symbol"], x["direction"], x["stage"], x["end_ts"])
        if k not in best or (-x["quality"], x["start_idx"], x["sensitivity"]) < (-best[k]["quality"], best[k]["start_idx"], best[k]["sensitivity"]):
            best[k] = x
    kept = []
    for x in sorted(best.values(), key=lambda x: (-x["quality"], x["stage"], x["start_idx"] - x["end_idx"], x["end_idx"], x["direction"])):
        a, b = x["start_idx"], x["end_idx"]
        if not any(y["symbol"] == x["symbol"] and min(b, y["end_idx"]) - max(a, y["start_idx"]) > overlap * min(b - a, y["end_idx"] - y["start_idx"]) for y in kept):
            kept.append(x)
    return sorted((x["symbol"], x["direction"], x["stage"], x["start_idx"], x["end_idx"], x["quality"]) for x in kept)


def test_islands_choose_alike(spark):
    r = random.Random(3)
    rows = []
    for symbol, gap, n in (("dense", 2, 150), ("sparse", 40, 120), ("one", 1, 1)):
        at = 1
        for _ in range(n):
            at += r.randint(0, gap)
            end = at + r.randint(5, 60)
            rows.append({"symbol": symbol, "interval": "1d", "sensitivity": r.choice([0.75, 2.0]), "direction": r.choice(["BULLISH", "BEARISH"]), "stage": r.choice("CV"), "quality": r.randint(40, 60), "start_idx": at, "end_idx": end, "end_ts": end, "cycle_key": f"{at}"})
    df = spark.createDataFrame(rows, "symbol string, interval string, sensitivity double, direction string, stage string, quality int, start_idx long, end_idx long, end_ts long, cycle_key string")
    got = V.historical_structures(df).collect()
    assert sorted((x.symbol, x.direction, x.stage, x.start_idx, x.end_idx, x.quality) for x in got) == plain(rows)
    assert V.historical_structures(df.limit(0)).count() == 0
