"""Numbers and moving sums of long ordered groups, chunk by chunk.

A window over a whole group puts its history into one task. Here a group is cut into
chunks along its order (days, months); a chunk's rows are numbered and summed alone, and
what crosses a border is carried: a chunk's start number, and sums of up to reach - 1
values before it, from the tails of the chunks before. Only chunks (not rows) of a group
meet in one task, and rows are shuffled by group and chunk. Where only groups of the rows
are wanted, the rows are read, shuffled and sorted once (chunk_groups, whole_groups).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inside_chunks(df: DataFrame, key: str, chunk: str, order: list[str], value: str, reach: int) -> DataFrame:
    """Adds _r (the row's number in its chunk), _s (the sum of value over the last `reach` rows of
    the chunk) and _tail (is it one of the chunk's last reach - 1 rows), from one sort."""
    if reach < 2:
        raise ValueError("reach below 2")
    inside = Window.partitionBy(key, chunk).orderBy(*order)
    # a running sum and the one `reach` rows before: a frame of reach rows would be added up anew for each row
    rows = df.withColumns({
        "_r": F.row_number().over(inside).cast("long"), "_s": F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "_tail": F.lead(F.lit(True), reach - 1).over(inside).isNull(),
    })
    return rows.withColumn("_s", F.col("_s") - F.coalesce(F.lag("_s", reach).over(inside), F.lit(0).cast("long")))


def carried(tails: DataFrame, key: str, chunk: str, number: str, value: str, reach: int) -> DataFrame:
    """key, chunk, _base (rows of the key before the chunk) and _before (sums of the last 0, 1, 2, ...
    values before it, up to reach - 1), from the rows that inside_chunks marks as tails."""
    chunks = tails.groupBy(key, chunk).agg(F.max(number).alias("_n"), F.array_sort(F.collect_list(F.struct((-F.col(number)).alias("_d"), F.col(value).alias("v")))).alias("_tail"))
    along = Window.partitionBy(key).orderBy(chunk)
    chunks = chunks.withColumn("_end", F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    # the chunks that hold any of the last reach - 1 rows up to this one's end, newest first
    near = Window.partitionBy(key).orderBy("_end").rangeBetween(-(reach - 2), 0)
    chunks = chunks.withColumn("_near", F.flatten(F.reverse(F.collect_list("_tail").over(near))))
    sums = F.aggregate(F.slice("_near", 1, reach - 1), F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["v"])))
    return chunks.withColumn("_after", sums).select(
        key, chunk, F.coalesce(F.lag("_end").over(along), F.lit(0).cast("long")).alias("_base"),
        F.coalesce(F.lag("_after").over(along), F.array(F.lit(0).cast("long"))).alias("_before"),
    )


def _more(number: str, reach: int) -> Column:
    """What a chunk's row lacks of its moving sum: the values before the chunk."""
    return F.when(F.col(number) < reach, F.get("_before", F.least(F.lit(reach) - F.col(number), F.size("_before") - 1).cast("int"))).otherwise(F.lit(0).cast("long"))


def moving_sums(df: DataFrame, key: str, chunk: str, order: list[str], value: str, reach: int) -> DataFrame:
    """Adds rn (long, 1, 2, ... within key by order) and moving (the sum of value over the last
    `reach` rows), as windows over key would. `order` names rows uniquely; `chunk` never
    falls along it and isn't null; value is a long and isn't null.
    """
    rows = inside_chunks(df, key, chunk, order, value, reach)
    out = rows.join(carried(rows.filter("_tail"), key, chunk, "_r", value, reach), [key, chunk])
    return out.select(*df.columns, (F.col("_r") + F.col("_base")).alias("rn"), (F.col("_s") + _more("_r", reach)).alias("moving"))


def chunk_groups(df: DataFrame, key: str, chunk: str, order: list[str], value: str, reach: int, by: dict[str, Column], total: str) -> DataFrame:
    """First half of grouped moving sums: the rows, shuffled and sorted once, become groups by key,
    chunk and `by` (names, and expressions over the rows). A chunk's first and last reach - 1 rows are groups of their own, as they miss
    what is carried to them, or carry. It is read twice by whole_groups, so write it between."""
    rows = inside_chunks(df, key, chunk, order, value, reach)
    edge = F.when((F.col("_r") < reach) | F.col("_tail"), F.col("_r")).otherwise(F.lit(0).cast("long"))
    return rows.groupBy(key, chunk, *[c.alias(k) for k, c in by.items()], edge.alias("_edge")).agg(
        F.min("_r").alias("first"), F.max("_r").alias("last"), F.min_by("_s", "_r").alias("open"), F.max("_s").alias("high"), F.min("_s").alias("low"),
        F.max_by("_s", "_r").alias("close"), F.sum(total).alias("total"), F.max(value).alias("_v"), F.max("_tail").alias("_tail"),
    )


def whole_groups(groups: DataFrame, key: str, chunk: str, reach: int, by: list[str]) -> DataFrame:
    """key, `by`, first and last (rn of the group's first and last row), open, close (their moving sums), high, low and total
    of each group: what grouping the rows of moving_sums would give, from chunk_groups."""
    sides = carried(groups.filter("_tail"), key, chunk, "last", "_v", reach).withColumnsRenamed({key: "_key", chunk: "_chunk"})
    all_ = groups.join(sides, groups[key].eqNullSafe(sides["_key"]) & (groups[chunk] == sides["_chunk"]))
    more = _more("first", reach)
    all_ = all_.select(
        key, *by, (F.col("first") + F.col("_base")).alias("first"), (F.col("last") + F.col("_base")).alias("last"),
        *[(F.col(c) + more).alias(c) for c in ("open", "high", "low", "close")], "total",
    )
    return all_.groupBy(key, *by).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min_by("open", "first").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "last").alias("close"), F.sum("total").alias("total"),
    )
