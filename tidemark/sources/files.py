"""Files: adjusted daily prices as CSV, result rows as CSV, and the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRICES = "ticker string, date string, open double, high double, low double, close double, volume bigint"
#: By how much a high may lie under, or a low over, the other prices (rounding of adjusted ones).
TOLERANCE = 1e-9


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder where the driver and all executors can write. Only a local master
    may do without spark.checkpoint.dir; it gets a folder that goes with the process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = _own[app]
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and not lost with an executor."""
    path = shared_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def consistent() -> Column:
    """Positive finite prices, and high and low that enclose open and close."""
    fine = F.col("volume") >= 0
    for c in ("open", "high", "low", "close"):
        fine = fine & (F.col(c) > 0) & (F.col(c) < float("inf"))
    body = [F.greatest("open", "close"), F.least("open", "close")]
    return F.coalesce(fine & (F.col("high") >= body[0] - TOLERANCE) & (F.col("low") <= body[1] + TOLERANCE), F.lit(False))


def adjusted_csv(spark: SparkSession, path: str, universe: DataFrame) -> DataFrame:
    """Daily bars of the universe's symbols (distinct, column symbol) from CSV files with
    a header (plain or .gz), and `good`: whether date and prices are usable. Bad rows are
    kept, so that they can be counted; a date becomes midnight UTC of the session's zone."""
    rows = spark.read.schema(PRICES).option("header", True).csv(path)
    at = F.col("date").try_cast("date").cast("timestamp")
    bars = rows.join(universe.select(F.col("symbol").alias("ticker")), "ticker", "left_semi")
    return bars.select(F.col("ticker").alias("symbol"), F.lit("1d").alias("interval"), at.alias("ts"), "open", "high", "low", "close", "volume", (consistent() & at.isNotNull()).alias("good"))


def write_rows(df: DataFrame, path: str, order: list[str]) -> None:
    """df as CSV with a header. Files are ranges of `order`, sorted within, so that their
    names' order is the rows' order."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path)


def read_rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path)
