"""Cluster bootstraps with exact multinomial weights.

In each replicate as many clusters of an axis are drawn, with replacement, as the axis has.
Draw d of replicate r is cluster md5(seed:r:axis:d) mod n of the clusters in order, so a
result is the same however the data is partitioned (and the modulo's bias is below n / 2^32).
Draws are counted per replicate and cluster: the weights.

Two axes: outcomes are summed per pair of clusters, and held as one array per cluster of the
first axis along the clusters of the second. A replicate's weights of the second axis are one
array too. So a replicate's sums are inner products of arrays over the drawn clusters of the
first axis, added up per replicate before they are shuffled; pairs of clusters are never
multiplied out with replicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.files import written

#: Least replicates; least share of them that must give a value; least outcomes for an interval.
LEAST, VALID, OUTCOMES = 1000, 0.95, 30
LOW, HIGH = 0.025, 0.975


def numbered(clusters: DataFrame, column: str) -> DataFrame:
    """Distinct non-null clusters (column `cluster`) with their place (from 0) in order: one row per cluster meets here."""
    names = clusters.select(F.col(column).alias("cluster")).filter("cluster IS NOT NULL").distinct()
    return names.withColumn("place", F.row_number().over(Window.orderBy("cluster")) - 1)


def weights(spark, n: int, replicates: int, axis: int, seed: int) -> DataFrame:
    """replicate, place, w: how often each place (below n) was drawn; undrawn ones have no row."""
    if n == 0:
        return spark.createDataFrame([], "replicate long, place int, w long")
    draws = spark.range(1, replicates + 1).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("d"))
    text = F.md5(F.concat_ws(":", F.lit(seed), F.col("replicate"), F.lit(axis), F.col("d")).cast("binary"))
    place = (F.conv(F.substring(text, 1, 8), 16, 10).cast("long") % n).cast("int")
    return draws.groupBy("replicate", place.alias("place")).agg(F.count("*").alias("w"))


def _checked(replicates: int) -> None:
    if replicates < LEAST:
        raise ValueError(f"at least {LEAST} replicates")


def _inner(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def cluster_bootstrap(trades: DataFrame, replicates: int = 10_000, seed: int = 0, axes: tuple[str, str] = ("symbol", "year"), universe: DataFrame | None = None, span: DataFrame | None = None) -> DataFrame:
    """s, f, precision, low, high, replicates: the precision of all trades and its 95 % percentile
    interval when the clusters of both axes are resampled. One row.

    The clusters of an axis are those of `universe` and `span` (frames with the axis' column), or
    those of the trades. low and high are null with fewer than OUTCOMES conclusive trades or if
    over 5 % of the replicates drew none; `replicates` counts those that drew some. Trades of no
    known cluster don't count in any replicate. Fewer than LEAST replicates are refused.
    """
    _checked(replicates)
    spark, (first, second) = trades.sparkSession, axes
    s, f = F.count_if(F.col("outcome") == "SUCCESS"), F.count_if(F.col("outcome") == "FAILURE")
    cells = written(trades.groupBy(F.col(first).alias("a"), F.col(second).alias("b")).agg(s.alias("s"), f.alias("f")), "cells")
    rows = numbered(cells, "a") if universe is None else numbered(universe, first)
    cols = numbered(cells, "b") if span is None else numbered(span, second)
    n, m = rows.count(), cols.count()
    placed = cells.join(rows.select(F.col("cluster").alias("a"), F.col("place").alias("row")), "a").join(cols.select(F.col("cluster").alias("b"), F.col("place").alias("col")), "b")
    vector = lambda c: F.transform(F.sequence(F.lit(0), F.lit(max(m, 1) - 1)), lambda k: F.coalesce(F.try_element_at(F.map_from_entries(F.collect_list(F.struct("col", c))), k), F.lit(0).cast("long")))
    held = placed.filter("s + f > 0").groupBy("row").agg(vector("s").alias("s"), vector("f").alias("f"))
    drawn = weights(spark, m, replicates, 1, seed)
    along = F.map_from_entries(F.collect_list(F.struct("place", "w")))
    drawn = drawn.groupBy("replicate").agg(F.transform(F.sequence(F.lit(0), F.lit(max(m, 1) - 1)), lambda k: F.coalesce(F.try_element_at(along, k), F.lit(0).cast("long"))).alias("along"))
    per = weights(spark, n, replicates, 0, seed).join(held, F.col("place") == F.col("row")).join(drawn, "replicate")
    per = per.groupBy("replicate").agg(F.sum(F.col("w") * _inner("s", "along")).alias("s"), F.sum(F.col("w") * _inner("f", "along")).alias("f"))
    estimates = per.filter("s + f > 0").select((F.col("s") * 100.0 / (F.col("s") + F.col("f"))).alias("p"))
    bounds = estimates.agg(F.percentile("p", F.lit(LOW)).alias("low"), F.percentile("p", F.lit(HIGH)).alias("high"), F.count("*").alias("replicates"))
    whole = cells.agg(F.coalesce(F.sum("s"), F.lit(0).cast("long")).alias("s"), F.coalesce(F.sum("f"), F.lit(0).cast("long")).alias("f"))
    fine = (F.col("s") + F.col("f") >= OUTCOMES) & (F.col("replicates") >= VALID * replicates)
    both = whole.join(bounds)  # a row each
    return both.select("s", "f", (F.col("s") * 100.0 / F.nullif(F.col("s") + F.col("f"), F.lit(0))).alias("precision"), F.when(fine, F.col("low")).alias("low"), F.when(fine, F.col("high")).alias("high"), "replicates")


def _bounds(name: str) -> list[Column]:
    """The floored 2.5 % and the ceiled 97.5 % place of a sorted list, one value per replicate."""
    x = F.array_sort(F.collect_list(name))
    last = F.size(x) - 1
    return [F.get(x, F.floor(last * LOW).cast("int")).alias(f"{name}_low"), F.get(x, F.ceil(last * HIGH).cast("int")).alias(f"{name}_high"), F.count(name).alias(f"{name}_replicates")]


def paired_bootstrap(pairs: DataFrame, replicates: int = 10_000, seed: int = 0) -> DataFrame:
    """pairs, uplift, uplift_low, uplift_high, uplift_replicates and the same of precision: how much the
    signals' mean return and precision exceed their controls', with intervals when symbols are resampled.

    pairs has symbol, signal_return, control_return, signal_outcome, control_outcome. A replicate
    without a conclusive signal or control gives no precision. With fewer than two pairs all
    intervals are null. One row. Fewer than LEAST replicates are refused.
    """
    _checked(replicates)
    hit = lambda side, kind: F.count_if(F.col(f"{side}_outcome") == kind)
    sums = {"n": F.count("*"), "d": F.sum(F.col("signal_return") - F.col("control_return"))}
    sums |= {f"{side[0]}{kind[0].lower()}": hit(side, kind) for side in ("signal", "control") for kind in ("SUCCESS", "FAILURE")}
    cells = written(pairs.filter("symbol IS NOT NULL").groupBy("symbol").agg(*[c.alias(k) for k, c in sums.items()]), "cells")
    clusters = numbered(cells, "symbol")
    n = clusters.count()
    held = cells.join(clusters, F.col("symbol") == F.col("cluster"))
    per = weights(pairs.sparkSession, n, replicates, 0, seed).join(held, "place").groupBy("replicate").agg(*[F.sum(F.col("w") * F.col(k)).alias(k) for k in sums])

    def values(df: DataFrame) -> DataFrame:
        share = lambda a, b: F.col(a) * 100.0 / F.nullif(F.col(a) + F.col(b), F.lit(0))
        return df.select("n", (F.col("d") / F.col("n")).alias("uplift"), (share("ss", "sf") - share("cs", "cf")).alias("precision"))

    whole = values(cells.agg(*[F.sum(k).alias(k) for k in sums])).withColumnRenamed("n", "pairs")
    bounds = values(per).agg(*_bounds("uplift"), *_bounds("precision"))
    few = F.coalesce("pairs", F.lit(0)) < 2
    out = whole.join(bounds)  # a row each
    ends = [c for c in bounds.columns if c.endswith(("_low", "_high"))]
    return out.withColumns({c: F.when(~few, F.col(c)) for c in ends}).withColumn("pairs", F.coalesce("pairs", F.lit(0).cast("long")))
