"""Matched controls: for each signal the nearest free bar without a signal.

Candidates come from an equi-join on buckets of bar numbers, so a signal meets the bars
around it alone, and are ranked by window. The choice is made signal by signal without
replacement; signals of a symbol and pattern that lie more than twice the distance apart
share no candidate, so each run of nearer ones is chosen for by itself.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_CHOSEN = "symbol string, pattern string, idx long, control_idx long, gap long, distance long"


def candidates(bars: DataFrame, signals: DataFrame, max_distance: int) -> DataFrame:
    """symbol, pattern, idx, control_idx, gap, distance of every bar that may serve a signal."""
    sizes = (1, 2, 3)
    trends = F.explode(F.array(*[F.struct(F.lit(k).alias("size"), F.col(f"trend_{k}").alias("trend"), F.col(f"trend_points_{k}").alias("points")) for k in sizes]))
    width = max_distance + 1
    free = bars.select("symbol", "idx", trends.alias("t")).select("symbol", "idx", "t.*").join(signals.select("symbol", "idx").distinct(), ["symbol", "idx"], "left_anti")
    free = free.select("symbol", "size", "trend", F.col("idx").cast("long").alias("control_idx"), F.col("points").alias("control_points"), F.expr(f"idx DIV {width}").alias("bucket"))
    pick = lambda name: F.when(F.col("size") == 1, F.col(f"{name}_1")).when(F.col("size") == 2, F.col(f"{name}_2")).otherwise(F.col(f"{name}_3"))
    own = signals.select("symbol", "pattern", F.col("size").cast("int").alias("size"), F.col("idx").cast("long").alias("idx"), pick("trend").alias("trend"), pick("trend_points").alias("points")).distinct()
    near = own.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.expr(f"idx DIV {width}") + k)))
    met = near.join(free, ["symbol", "size", "trend", "bucket"]).withColumns({"distance": F.abs(F.col("idx") - F.col("control_idx")), "gap": F.abs(F.col("points") - F.col("control_points")).cast("long")})
    return met.filter(F.col("distance") <= max_distance).select("symbol", "pattern", "idx", "control_idx", "gap", "distance")


def matched_controls(bars: DataFrame, signals: DataFrame, max_distance: int = 63) -> DataFrame:
    """symbol, pattern, idx, control_idx, gap, distance: each signal's control, of the same symbol and
    prior trend (before a pattern of its size) at most max_distance bars off: least trend-score gap,
    then distance, then index, among bars without a signal that no earlier signal of the pattern took.

    bars: symbol, idx, trend_1..3, trend_points_1..3; signals: these, pattern and size. A signal
    without a candidate has no row.
    """
    met = candidates(bars, signals, max_distance)
    along = Window.partitionBy("symbol", "pattern").orderBy("idx")
    own = met.select("symbol", "pattern", "idx").distinct().withColumn("fresh", F.coalesce(F.col("idx") - F.lag("idx").over(along) > 2 * max_distance, F.lit(True)).cast("int"))
    runs = own.select("symbol", "pattern", "idx", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        taken, served, out = set(), None, []
        for r in rows.sort_values(["idx", "gap", "distance", "control_idx"]).itertuples(index=False):
            if r.idx != served and r.control_idx not in taken:
                taken.add(r.control_idx)
                served = r.idx
                out.append((r.symbol, r.pattern, r.idx, r.control_idx, r.gap, r.distance))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _CHOSEN.split(", ")])

    return met.join(runs, ["symbol", "pattern", "idx"]).groupBy("symbol", "pattern", "run").applyInPandas(choose, _CHOSEN)
