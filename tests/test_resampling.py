"""Bootstraps and matched controls against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.operators import bootstrap as BS
from tidemark.operators import matched as MC


def drawn(names, replicate, axis, seed):
    n = len(names)
    return Counter(names[int(hashlib.md5(f"{seed}:{replicate}:{axis}:{d}".encode()).hexdigest()[:8], 16) % n] for d in range(1, n + 1))


TRADES = "symbol string, year int, outcome string"


def trades(seed, n=600):
    r = random.Random(seed)
    return [(f"s{int(r.random() ** 2 * 17)}", 2000 + r.randint(0, 6), r.choice(["SUCCESS", "FAILURE", "INCONCLUSIVE", "SUCCESS"])) for _ in range(n)]


@pytest.mark.parametrize("known", [False, True])
def test_cluster_bootstrap_is_the_two_way_draw(spark, known):
    rows = trades(4)
    symbols, years = (sorted({f"s{k}" for k in range(25)}), list(range(1998, 2008))) if known else (sorted({x[0] for x in rows}), sorted({x[1] for x in rows}))
    estimates = []
    for k in range(1, 1001):
        a, b = drawn(symbols, k, 0, 5), drawn(years, k, 1, 5)
        assert sum(a.values()) == len(symbols) and sum(b.values()) == len(years)
        s, f = (sum(a[x[0]] * b[x[1]] for x in rows if x[2] == kind) for kind in ("SUCCESS", "FAILURE"))
        if s + f:
            estimates.append(100 * s / (s + f))
    more = {"universe": spark.createDataFrame([(x,) for x in symbols] * 2, "symbol string"), "span": spark.createDataFrame([(x,) for x in years], "year int")} if known else {}
    df = spark.createDataFrame(rows, TRADES)
    got, again = (BS.cluster_bootstrap(d, 1000, 5, **more).first() for d in (df.repartition(7), df.coalesce(1)))
    assert got == again and got.replicates == len(estimates)
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(estimates, [2.5, 97.5])))
    s, f = (sum(x[2] == k for x in rows) for k in ("SUCCESS", "FAILURE"))
    assert (got.s, got.f, got.precision) == (s, f, pytest.approx(100 * s / (s + f)))


def test_cluster_bootstrap_odd_tables(spark):
    with pytest.raises(ValueError):
        BS.cluster_bootstrap(spark.createDataFrame([], TRADES), 999)
    assert tuple(BS.cluster_bootstrap(spark.createDataFrame([], TRADES), 1000).first()) == (0, 0, None, None, None, 0)
    few = BS.cluster_bootstrap(spark.createDataFrame([("a", 2000, "SUCCESS")] * 20 + [(None, 2000, "FAILURE")], TRADES), 1000).first()
    assert (few.s, few.f, few.low, few.high, few.replicates) == (20, 1, None, None, 1000)


PAIRS = "symbol string, signal_return double, control_return double, signal_outcome string, control_outcome string"


def test_paired_bootstrap_is_the_draw_of_symbols(spark):
    r = random.Random(8)
    kind = lambda: r.choice(["SUCCESS", "FAILURE", "INCONCLUSIVE"])
    rows = [(f"s{int(r.random() ** 2 * 9)}", r.gauss(1, 3), r.gauss(0, 3), kind(), kind()) for _ in range(120)]
    by = defaultdict(list)
    for x in rows:
        by[x[0]].append(x)

    def values(sample):
        share = lambda k: (lambda s, f: 100 * s / (s + f) if s + f else None)(*(sum(x[k] == o for x in sample) for o in ("SUCCESS", "FAILURE")))
        a, b = share(3), share(4)
        return sum(x[1] - x[2] for x in sample) / len(sample), None if a is None or b is None else a - b

    uplift, precision = zip(*[values([x for s, w in drawn(sorted(by), k, 0, 0).items() for x in by[s] * w]) for k in range(1, 1001)], strict=True)
    got = BS.paired_bootstrap(spark.createDataFrame(rows, PAIRS), 1000).first()
    for name, xs in (("uplift", uplift), ("precision", precision)):
        xs = sorted(x for x in xs if x is not None)
        last = len(xs) - 1
        want = (xs[math.floor(last * 0.025)], xs[math.ceil(last * 0.975)], len(xs))
        assert (got[f"{name}_low"], got[f"{name}_high"], got[f"{name}_replicates"]) == (pytest.approx(want[0]), pytest.approx(want[1]), want[2])
    assert (got.pairs, got.uplift, got.precision) == (120, *[pytest.approx(v) for v in values(rows)])
    one = BS.paired_bootstrap(spark.createDataFrame(rows[:1], PAIRS), 1000).first()
    assert (one.pairs, one.uplift_low, one.uplift_high) == (1, None, None)
    assert BS.paired_bootstrap(spark.createDataFrame([], PAIRS), 1000).first().pairs == 0


def test_controls_equal_the_choice_one_by_one(spark):
    r = random.Random(11)
    bars, signals = [], []
    for symbol, n, share in (("dense", 400, 0.3), ("sparse", 900, 0.01), ("none", 50, 0.0)):
        for i in range(1, n + 1):
            b = {"symbol": symbol, "idx": i} | {f"trend_{k}": r.choice(["UP", "DOWN", "NONE"]) for k in (1, 2, 3)} | {f"trend_points_{k}": r.randint(0, 6) for k in (1, 2, 3)}
            bars.append(b)
            if r.random() < share:
                signals += [b | {"pattern": p, "size": k} for p, k in r.sample([("A", 1), ("B", 2), ("C", 3)], r.randint(1, 2))]
    taken, asked, want = defaultdict(set), {(s["symbol"], s["idx"]) for s in signals}, []
    for s in sorted(signals, key=lambda s: (s["symbol"], s["pattern"], s["idx"])):
        k, used = s["size"], taken[s["symbol"], s["pattern"]]
        pool = [(abs(b[f"trend_points_{k}"] - s[f"trend_points_{k}"]), abs(b["idx"] - s["idx"]), b["idx"]) for b in bars if b["symbol"] == s["symbol"] and (b["symbol"], b["idx"]) not in asked and b[f"trend_{k}"] == s[f"trend_{k}"] and abs(b["idx"] - s["idx"]) <= 20 and b["idx"] not in used]
        if pool:
            gap, distance, at = min(pool)
            used.add(at)
            want.append((s["symbol"], s["pattern"], s["idx"], at, gap, distance))
    shape = "symbol string, idx long, " + ", ".join(f"trend_{k} string, trend_points_{k} int" for k in (1, 2, 3))
    b = spark.createDataFrame(bars, shape)
    got = MC.matched_controls(b, spark.createDataFrame(signals, shape + ", pattern string, size int"), 20)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(want) > 100 and MC.matched_controls(b, spark.createDataFrame([], shape + ", pattern string, size int"), 20).count() == 0
