"""Recursive averages over a whole history, as a blocked prefix scan.

A step of y <- y + alpha * (x - y) is the map y -> r * y + alpha * x with r = 1 - alpha,
and maps compose: n of them are y -> r^n * y + b. Bars are dealt in blocks of BLOCK by
their number. Inside a block the b of every prefix is one running sum, of
alpha * x * r^-place, brought back by r^place: BLOCK keeps the powers far from a double's
limits, and what a running sum rounds off is as small beside the newest terms as the old
terms are. The maps of whole blocks are scanned bar by bar of their ends alone, which
gives each block's entry; a bar's value is its own map applied to its block's entry.

So a row costs a few running sums however long its history is, nothing is cut off, and
all series share one exchange and one sort: (symbol, interval) by (block, ts).
Series run as differences from their first value, so a constant series stays constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bars of a block.
BLOCK = 512
#: The largest factor: r^-BLOCK stays under 2^812.
FASTEST = 2.0 / 3.0


def with_averages(df: DataFrame, series: dict[str, tuple[Column, float]]) -> DataFrame:
    """Adds, per name, the recursive average of a column by a factor alpha (0 < alpha <= 2/3, or 1),
    begun with the first value. df has symbol, interval, ts and idx (1, 2, ... by ts);
    values aren't null. An average of averages needs a second call.
    """
    for name, (_, alpha) in series.items():
        if not (0 < alpha <= FASTEST or alpha == 1):
            raise ValueError(f"factor of {name}: {alpha}")
    inside = Window.partitionBy("symbol", "interval", "_block").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("symbol", "interval").orderBy("_block", "ts")
    upto, before = across.rowsBetween(Window.unboundedPreceding, 0), across.rowsBetween(Window.unboundedPreceding, -1)
    names, own, place = df.columns, {k: v for k, v in series.items() if v[1] != 1}, F.col("_place")
    kept = {k: 1.0 - a for k, (_, a) in own.items()}
    df = df.withColumns({"_block": F.floor((F.col("idx") - 1) / BLOCK).cast("int"), "_place": ((F.col("idx") - 1) % BLOCK).cast("double")})
    df = df.withColumns({f"_x_{k}": x for k, (x, _) in series.items()})
    df = df.withColumns({f"_1_{k}": F.first(f"_x_{k}").over(upto) for k in own})
    term = lambda k, r: (F.col(f"_x_{k}") - F.col(f"_1_{k}")) * (1.0 - r) * F.pow(F.lit(r), -place)
    df = df.withColumns({f"_t_{k}": term(k, r) for k, r in kept.items()})
    df = df.withColumns({f"_b_{k}": F.sum(f"_t_{k}").over(inside) for k in own})
    df = df.withColumns({f"_b_{k}": F.col(f"_b_{k}") * F.pow(F.lit(r), place) for k, r in kept.items()})
    # the maps of all blocks before: the lists grow by one per BLOCK bars, and are folded once a block
    df = df.withColumns({f"_m_{k}": F.collect_list(F.when(place == BLOCK - 1, F.col(f"_b_{k}"))).over(before) for k in own})
    entry = lambda k, r: F.when(place == 0, F.aggregate(f"_m_{k}", F.lit(0.0), lambda y, b: y * F.lit(r**BLOCK) + b))
    df = df.withColumns({f"_m_{k}": entry(k, r) for k, r in kept.items()})
    df = df.withColumns({f"_e_{k}": F.first(f"_m_{k}").over(inside) for k in own})
    value = lambda k, r: F.col(f"_1_{k}") + F.col(f"_b_{k}") + F.pow(F.lit(r), place + 1) * F.col(f"_e_{k}")
    return df.select(*[F.col(c) for c in names if c not in series], *[(value(k, kept[k]) if k in own else F.col(f"_x_{k}")).alias(k) for k in series])
