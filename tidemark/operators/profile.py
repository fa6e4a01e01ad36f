"""Which bars an anchored volume profile is made of, live or frozen at a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTRADAY = "15min"
_BAR = ["ts", "open", "high", "low", "close", "volume"]


def selected(bars: DataFrame, anchors: DataFrame) -> DataFrame:
    """The bars of each anchored profile, with `calculated`, the interval(s) they have.

    anchors: symbol, want (interval asked for), anchor, active (start of the bar that
    is still open), one row a symbol and want; optionally `frozen`, a struct of
    interval and bar (ts, open .. volume), null while the profile is live.

    A daily profile has the completed days before the active one and that day's
    15-minute bars; without any of those, the live daily bar. Other intervals take
    their bars from the anchor on. A frozen profile is cut at its snapshot, which
    stands in for everything from its own time on; a snapshot of another interval
    than the part it would end leaves that part empty.
    """
    if "frozen" not in anchors.columns:
        anchors = anchors.withColumn("frozen", F.lit(None).cast("struct<interval:string,ts:timestamp,open:double,high:double,low:double,close:double,volume:bigint>"))
    keys = ["symbol", "want"]
    a = anchors.select(*keys, "anchor", "active", "frozen")
    b = bars.select("symbol", "interval", *_BAR).join(a, "symbol").filter((F.col("interval") == F.col("want")) | ((F.col("want") == "1d") & (F.col("interval") == INTRADAY)))
    daily, live = F.col("want") == "1d", F.col("frozen").isNull()
    ts, active, start = F.col("ts"), F.col("active"), F.greatest("anchor", "active")
    part = (
        F.when(~daily, F.when((ts >= F.col("anchor")) & (live | (ts < active)), "bars"))
        .when(F.col("interval") == INTRADAY, F.when((ts >= active) & (live | ((F.col("frozen.interval") == INTRADAY) & (ts < F.col("frozen.ts")))), "intraday"))
        .when((ts >= F.col("anchor")) & (ts < active), "completed")
        .when((ts >= start) & live, "daily")
    )
    f = F.col("frozen")
    cut = a.filter("frozen IS NOT NULL").select(
        *keys, f["interval"].alias("interval"), *[f[c].alias(c) for c in _BAR],
        F.when(~daily, F.when((f["interval"] == F.col("want")) & (f["ts"] >= start), "bars"))
        .when(f["interval"] == INTRADAY, F.when(f["ts"] >= active, "intraday"))
        .when((f["interval"] == "1d") & (f["ts"] >= start), "daily").alias("part"),
    )
    rows = b.select(*keys, "interval", *_BAR, part.alias("part")).unionByName(cut).filter("part IS NOT NULL")
    has = lambda p: F.bool_or(F.col("part") == p)
    kinds = rows.groupBy(*keys).agg(has("intraday").alias("intraday"), has("completed").alias("completed"))
    kept = rows.join(kinds, keys).filter("NOT (part = 'daily' AND intraday)")
    calculated = F.when(~F.col("intraday"), F.col("want")).when(F.col("completed"), "1d+15min").otherwise(INTRADAY)
    return kept.select(*keys, "interval", *_BAR, calculated.alias("calculated"))
