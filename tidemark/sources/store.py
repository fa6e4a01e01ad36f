"""Stored bars: a table partitioned by interval and bucketed by symbol.

A scan by interval, symbol and time reads one partition folder, the symbols' buckets and
the row groups of that time. Windows and joins by symbol and interval, or by more that
begins with the symbol, need no exchange: the buckets are their distribution.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import shared_folder

#: Rows that a bucket of one interval should hold, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 20_000_000, 8192


def buckets_for(rows: int, tasks: int) -> int:
    """At least a bucket per task, more where buckets would grow too large."""
    return min(MOST_BUCKETS, max(1, tasks, -(-rows // BUCKET_ROWS)))


def save(bars: DataFrame, name: str | None = None, buckets: int = 8, mode: str = "errorifexists") -> str:
    """Writes bars (symbol, interval, ts and more) as a table and returns its name. One file per
    bucket and interval, its rows in order of symbol and time. mode "append" adds rows (with
    the table's own number of buckets); "overwrite" replaces all."""
    spark = bars.sparkSession
    name = name or f"bars_{uuid.uuid4().hex}"
    columns = [*[c for c in bars.columns if c != "interval"], "interval"]
    dealt = bars.select(*columns).repartition(buckets, "symbol").sortWithinPartitions("interval", "symbol", "ts")
    out = dealt.write.format("parquet").mode(mode).partitionBy("interval").bucketBy(buckets, "symbol").sortBy("symbol", "ts")
    (out if spark.catalog.tableExists(name) else out.option("path", shared_folder(spark, "bars"))).saveAsTable(name)
    return name


def read(spark: SparkSession, name: str, like: list[str] | None = None) -> DataFrame:
    """The table's bars, with columns in the order of `like`."""
    df = spark.table(name)
    return df.select(*like) if like else df


def of_interval(spark: SparkSession, name: str, interval: str) -> DataFrame:
    """One interval's bars; the filter is on the partition."""
    return spark.table(name).filter(F.col("interval") == interval)
