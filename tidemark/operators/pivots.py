"""Swing pivots of long histories, chunk by chunk.

The fold that finds pivots is sequential: its state is a side and the best bar so far.
Only that bar's price and reach matter later, and from an unknown entry state they matter
only until a chunk's first event: the first bar that goes at least as far (a record of the
chunk) or that turns back by the reach (a record of the other side). After it the state is
one of the chunk's own bars. So a chunk is folded once from each record, which gives a short
table from entry states to exit states; the tables of a symbol's chunks are joined in order
(a fold of one entry per chunk), and then each chunk emits its turns from its known entry.

Where the fold begins, the running highest and lowest bars, are window aggregates. Turns
become pivots by rules that look at like neighbours only, so runs of turns that may touch
each other are folded alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.indicators import W
from tidemark.sources.files import written

#: Bars of a chunk.
CHUNK = 4096
#: Least part of the price that a reach has, times the sensitivity.
FLOOR = 0.0125
KEY = ["symbol", "interval"]
_TABLE = [("at", "double"), ("bar", "long"), ("side", "int"), ("best", "long"), ("v", "double"), ("r", "double")]
_NAMES = [f"{d}{e}_{k}" for d in "ud" for e in "et" for k, _ in _TABLE]
_SUMMARY = "symbol string, interval string, chunk long, s double, start_side int, start_best long, start_v double, start_r double, " + ", ".join(f"{n} array<{t}>" for n, t in zip(_NAMES, [t for _, t in _TABLE] * 4, strict=True))
_TURNS = "symbol string, interval string, s double, bar long, best long, sign int, price double"


class Chunk:
    """One chunk's bars for one sensitivity. A state is (side, best bar's number, its price
    times side, its reach); bars are numbered from `first`."""

    def __init__(self, first: int, high: np.ndarray, low: np.ndarray, close: np.ndarray, reach: np.ndarray):
        self.first, self.n, self.reach = first, len(high), reach
        self.ahead, self.back = {1: high, -1: -low}, {1: low, -1: -high}
        middle = close - (high + low) / 2
        self.own = {1: middle <= 0, -1: middle >= 0}
        self.known: dict[tuple[int, int], tuple[int, int]] = {}

    def event(self, side: int, v: float, r: float, i: int) -> tuple[int, bool]:
        """The first bar from i on that extends (True) or turns (False); n if none."""
        while i < self.n:
            a, b = self.ahead[side][i : i + 128], self.back[side][i : i + 128]
            hit = (a >= v) | (v - b >= r)
            k = int(hit.argmax())
            if hit[k]:
                return i + k, bool(a[k] >= v)
            i += 128
        return self.n, False

    def extended(self, side: int, i: int) -> int:
        """The side after bar i became the best: it may turn on itself."""
        return -side if self.ahead[side][i] - self.back[side][i] >= self.reach[i] and self.own[side][i] else side

    def exit(self, side: int, i: int) -> tuple[int, int]:
        """(side, best) at the chunk's end, from the state after bar i with bar i the best."""
        path = []
        while (side, i) not in self.known:
            path.append((side, i))
            j, more = self.event(side, self.ahead[side][i], self.reach[i], i + 1)
            if j == self.n:
                self.known[side, i] = (side, i)
                break
            side, i = (self.extended(side, j) if more else -side), j
        end = self.known[side, i]
        self.known.update(dict.fromkeys(path, end))
        return end

    def state(self, side: int, i: int) -> tuple[int, int, float, float]:
        return side, self.first + i, float(self.ahead[side][i]), float(self.reach[i])

    def from_entry(self, side: int, best: int, v: float, r: float, i: int) -> tuple[int, int, float, float]:
        """The exit state from an entry state that holds before bar i."""
        j, more = self.event(side, v, r, i)
        return (side, best, v, r) if j == self.n else self.state(*self.exit(self.extended(side, j) if more else -side, j))

    def table(self, side: int, extends: bool) -> list[tuple]:
        """(price reached, bar, exit state...) of each bar that can be a chunk's first event."""
        x = self.ahead[side] if extends else -self.back[side]
        records = np.flatnonzero(np.concatenate([[True], x[1:] > np.maximum.accumulate(x)[:-1]]))
        return [(float(self.ahead[side][i] if extends else self.back[side][i]), self.first + i, *self.state(*self.exit(self.extended(side, i) if extends else -side, i))) for i in records.tolist()]

    def turns(self, side: int, best: int, v: float, r: float, i: int) -> list[tuple[int, int, int, float]]:
        """(bar, best, sign, price) of each turn from an entry state that holds before bar i."""
        out = []
        while True:
            i, more = self.event(side, v, r, i)
            if i == self.n:
                return out
            if more:
                best, v, r = self.first + i, float(self.ahead[side][i]), float(self.reach[i])
            if not more or self.extended(side, i) != side:
                out.append((self.first + i, best, side, v * side))
                side, best, v, r = self.state(-side, i)
            i += 1


def reach(volatility: Column, close: Column, s: float) -> Column:
    return F.greatest(volatility * s, F.abs(close) * FLOOR * s)


def with_volatility(enriched: DataFrame) -> DataFrame:
    """The average true range, or where it is missing the mean of the last 14 bars' ranges."""
    before = F.lag("close").over(W())
    true = F.greatest(F.col("high") - F.col("low"), F.coalesce(F.abs(F.col("high") - before), F.lit(0.0)), F.coalesce(F.abs(F.col("low") - before), F.lit(0.0)), F.lit(1e-6))
    df = enriched.withColumn("_used", F.when(F.col("atr") > 0, F.col("atr")).otherwise(true))
    return df.withColumn("vol", F.when(F.col("atr") > 0, F.col("atr")).otherwise(F.avg("_used").over(W().rowsBetween(-13, 0)))).drop("_used")


def _beginnings(bars: DataFrame, sensitivities: tuple[float, ...]) -> DataFrame:
    """Per sensitivity the bar at which a first leg is long enough, its first pivot and the state after it."""
    upto = Window.partitionBy(*KEY).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    df = bars.withColumns({"_top": F.max(F.struct("high", "idx", "vol", "close")).over(upto), "_low": F.min(F.struct("low", (-F.col("idx")).alias("i"), "vol", "close")).over(upto)})
    top, low = F.col("_top"), F.col("_low")
    bottom, far = -low["i"], top["high"] - low["low"]
    rising = (bottom < top["idx"]) | ((bottom == top["idx"]) & (F.col("close") >= (F.col("high") + F.col("low")) / 2))

    def at(s: float) -> Column:
        a, b = reach(top["vol"], top["close"], s), reach(low["vol"], low["close"], s)
        state = F.struct(
            F.col("idx").alias("bar"), F.when(rising, 1).otherwise(-1).alias("side"), F.when(rising, top["idx"]).otherwise(bottom).alias("best"),
            F.when(rising, top["high"]).otherwise(-low["low"]).alias("v"), F.when(rising, a).otherwise(b).alias("r"),
            F.when(rising, bottom).otherwise(top["idx"]).alias("first"), F.when(rising, low["low"]).otherwise(top["high"]).alias("price"),
        )
        return F.min(F.when((F.col("idx") > 1) & (far >= F.greatest(a, b)), state))

    found = df.groupBy(*KEY).agg(*[at(s).alias(f"b{k}") for k, s in enumerate(sensitivities)])
    each = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("s"), F.col(f"b{k}").alias("b")) for k, s in enumerate(sensitivities)]))
    return found.select(*KEY, each.alias("x")).select(*KEY, "x.s", "x.b.*").filter("bar IS NOT NULL").withColumn("chunk", F.expr(f"(bar - 1) DIV {CHUNK}"))


def _opened(bars: pd.DataFrame, s: float) -> Chunk:
    h, lo, c, vol = (bars[x].to_numpy(float) for x in ("high", "low", "close", "vol"))
    return Chunk(int(bars["idx"].iloc[0]), h, lo, c, np.maximum(vol * s, np.abs(c) * FLOOR * s))


def turns(enriched: DataFrame, sensitivities: tuple[float, ...]) -> DataFrame:
    """symbol, interval, s, bar (where it is seen), best (the extreme's bar), sign (1 for a high), price: each turn, the beginning too."""
    cols = with_volatility(enriched).select(*KEY, "idx", "high", "low", "close", "vol", F.expr(f"(idx - 1) DIV {CHUNK}").alias("chunk"), F.max("idx").over(Window.partitionBy(*KEY)).alias("n"))
    bars = written(cols, "pivots")
    begins = written(_beginnings(bars, sensitivities), "pivots")
    more = F.col("chunk") < F.expr(f"(n - 1) DIV {CHUNK}")

    def summarise(rows: pd.DataFrame, begun: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            rows = rows.sort_values("idx")
            starts = {b.s: b for b in begun.itertuples()}
            for s in sensitivities:
                c, b = _opened(rows, s), starts.get(s)
                start = c.from_entry(int(b.side), int(b.best), b.v, b.r, int(b.bar) + 1 - c.first) if b else (None,) * 4
                tables = [c.table(side, e) for side in (1, -1) for e in (True, False)]
                lists = [[x[k] for x in t] for t in tables for k in range(len(_TABLE))]
                out.append((rows["symbol"].iloc[0], rows["interval"].iloc[0], int(rows["chunk"].iloc[0]), s, *start, *lists))
        df = pd.DataFrame(out, columns=["symbol", "interval", "chunk", "s", "start_side", "start_best", "start_v", "start_r", *_NAMES])
        return df.astype({"start_side": "Int32", "start_best": "Int64"})

    keys = [*KEY, "chunk"]
    summaries = bars.filter(more).groupBy(*keys).cogroup(begins.groupBy(*keys)).applyInPandas(summarise, _SUMMARY)
    entries = _entries(summaries).unionByName(begins.select(*KEY, "s", "chunk", "side", "best", "v", "r", F.col("bar").alias("after")))

    def emit(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(states):
            rows = rows.sort_values("idx")
            for e in states.itertuples():
                c = _opened(rows, e.s)
                out += [(e.symbol, e.interval, e.s, *t) for t in c.turns(int(e.side), int(e.best), e.v, e.r, max(0, int(e.after) + 1 - c.first))]
        return pd.DataFrame(out, columns=["symbol", "interval", "s", "bar", "best", "sign", "price"])

    found = bars.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInPandas(emit, _TURNS)
    return found.unionByName(begins.select(*KEY, "s", "bar", F.col("first").alias("best"), (-F.col("side")).alias("sign"), "price"))


def _entries(summaries: DataFrame) -> DataFrame:
    """The state at the entry of each chunk after the one where the fold begins."""
    state = "struct<side:int,best:bigint,v:double,r:double>"
    zipped = {f"{d}{e}": F.arrays_zip(*[F.col(f"{d}{e}_{k}").alias(k) for k, _ in _TABLE]) for d in "ud" for e in "et"}
    start = F.when(F.col("start_side").isNotNull(), F.struct(F.col("start_side").alias("side"), F.col("start_best").alias("best"), F.col("start_v").alias("v"), F.col("start_r").alias("r")))
    one = F.struct("chunk", start.alias("start"), *[z.alias(k) for k, z in zipped.items()])
    per = summaries.groupBy(*KEY, "s").agg(F.array_sort(F.collect_list(one), lambda a, b: (a["chunk"] - b["chunk"]).cast("int")).alias("chunks"))

    def leave(now: Column, c: Column) -> Column:
        first = lambda table, fits: F.get(F.filter(table, fits), F.lit(0))
        e = first(F.when(now["side"] > 0, c["ue"]).otherwise(c["de"]), lambda x: x["at"] >= now["v"])
        t = first(F.when(now["side"] > 0, c["ut"]).otherwise(c["dt"]), lambda x: now["v"] - x["at"] >= now["r"])
        x = F.when(e.isNotNull() & (t.isNull() | (e["bar"] <= t["bar"])), e).otherwise(t)
        moved = F.struct(*[x[k].alias(k) for k in ("side", "best", "v", "r")])
        return F.when(c["start"].isNotNull(), c["start"]).when(now.isNull() | x.isNull(), now).otherwise(moved)

    def step(acc: Column, c: Column) -> Column:
        after = leave(acc["now"], c).cast(state)
        entry = F.struct((c["chunk"] + 1).alias("chunk"), after.alias("state"))
        return F.struct(after.alias("now"), F.concat(acc["out"], F.array(entry)).alias("out"))

    zero = F.struct(F.lit(None).cast(state).alias("now"), F.array().cast(f"array<struct<chunk:bigint,state:{state}>>").alias("out"))
    out = per.select(*KEY, "s", F.explode(F.aggregate("chunks", zero, step, lambda a: a["out"])).alias("e")).filter("e.state IS NOT NULL")
    return out.select(*KEY, "s", "e.chunk", "e.state.*", F.lit(0).cast("long").alias("after"))


def from_turns(found: DataFrame) -> DataFrame:
    """symbol, interval, s, bar, k, best, sign, price: the pivots. A turn on its predecessor's own
    bar counts for nothing; of two like ones that then follow each other the more extreme stays."""
    w = Window.partitionBy(*KEY, "s").orderBy("bar")
    p, pp = F.lag("best").over(w), F.lag("best", 2).over(w)
    fresh = p.isNull() | ((F.col("best") != p) & (pp.isNull() | (p != pp)))
    runs = found.withColumn("fresh", fresh).withColumn("run", F.sum(F.col("fresh").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*KEY, "s", "run").agg(F.array_sort(F.collect_list(F.struct("bar", "best", "sign", "price"))).alias("t"))

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        kept = F.slice(out, 1, F.size(out) - 1)
        more = (x["price"] - last["price"]) * x["sign"] > 0
        return F.when(last["sign"] == x["sign"], F.when(more, F.concat(kept, F.array(x))).otherwise(out)).when(last["best"] != x["best"], F.concat(out, F.array(x))).otherwise(out)

    folded = F.aggregate(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(1))), F.slice("t", 1, 1), step)
    return runs.select(*KEY, "s", "run", F.posexplode(folded).alias("k", "x")).select(*KEY, "s", "run", "k", "x.best", "x.sign", "x.price")


def pivots(enriched: DataFrame, sensitivities: tuple[float, ...]) -> DataFrame:
    """symbol, interval, sensitivity, seq, idx, ts, kind, price, as a written table: one row per
    pivot and sensitivity with five or more; of sensitivities with the same pivots the smallest.

    enriched has symbol, interval, ts, idx (1, 2, ... by ts), high, low, close, atr.
    """
    p = from_turns(turns(enriched, sensitivities))
    p = p.withColumn("seq", F.row_number().over(Window.partitionBy(*KEY, "s").orderBy("run", "k")) - 1)
    p = written(p.select(*KEY, "s", "seq", "best", "sign", "price"), "pivots")
    sets = p.groupBy(*KEY, "s").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("best", "sign")).alias("x"), F.bit_xor(F.xxhash64("sign", "best", "seq")).alias("y")).filter("n >= 5")
    kept = sets.groupBy(*KEY, "n", "x", "y").agg(F.min("s").alias("s")).select(*KEY, "s")
    at = enriched.select(*KEY, F.col("idx").cast("long").alias("best"), "ts")
    out = p.join(kept, [*KEY, "s"]).join(at, [*KEY, "best"])
    kind = F.when(F.col("sign") > 0, "HIGH").otherwise("LOW")
    return written(out.select(*KEY, F.col("s").alias("sensitivity"), F.col("seq").cast("int").alias("seq"), F.col("best").alias("idx"), "ts", kind.alias("kind"), "price"), "pivots")
