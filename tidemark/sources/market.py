"""Price bars and their surroundings, derived from the star-schema tables.

Bars have the columns symbol, interval ('1d', '1wk', '1mo'), ts, open, high, low,
close (double) and volume (long). Prices are built from integer cents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.chunked import chunk_groups, moving_sums, whole_groups
from tidemark.sources import store
from tidemark.sources.files import written

UNITS = {"1d": "day", "1wk": "week", "1mo": "month"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Trades whose steps add up to a price.
STEPS = 200
#: Line items from which they are numbered by the month and by the day, instead of by the year.
BY_MONTH, BY_DAY = 50_000_000, 5_000_000_000


def chunk_unit(rows: int) -> str:
    """How finely a symbol's history is cut: a chunk should hold many more trades than STEPS, and fit a task."""
    return "year" if rows < BY_MONTH else "month" if rows < BY_DAY else "day"


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, k1..k4, volume, flag, step, chunk: one trade per line item."""
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("symbol"), F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("k1"),
        F.col("l_linenumber").alias("k2"), F.col("l_partkey").alias("k3"), F.col("l_suppkey").alias("k4"),
        F.col("l_quantity").cast("long").alias("volume"), F.col("l_returnflag").alias("flag"),
        (F.round(F.col("l_extendedprice") * 100).cast("long") % 401 - 200).alias("step"),
        F.coalesce(F.date_trunc(chunk_unit(line.count()), "l_shipdate"), F.lit("0001-01-01").cast("timestamp")).alias("chunk"),
    )


ORDER = ["ts", "k1", "k2", "k3", "k4"]


def _price(moving: str) -> Column:
    return (F.lit(10000) + F.col(moving)).cast("double") / F.lit(100.0)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, k1..k4, volume, flag, price, rn: one trade per line item, in order."""
    t = moving_sums(trades(spark, sf_dir), "symbol", "chunk", ORDER, "step", STEPS)
    return t.select("symbol", *ORDER, "volume", "flag", _price("moving").alias("price"), "rn")


def summed(spark: SparkSession, sf_dir: str, **by: Column) -> DataFrame:
    """symbol, `by`, first and last rn, open, high, low, close, volume of the trades' groups by expressions over them, from one
    pass over the trades; written once."""
    groups = written(chunk_groups(trades(spark, sf_dir), "symbol", "chunk", ORDER, "step", STEPS, by, "volume"), "groups")
    t = whole_groups(groups, "symbol", "chunk", STEPS, list(by))
    return written(t.select("symbol", *by, "first", "last", *[_price(c).alias(c) for c in ("open", "high", "low", "close")], F.col("total").alias("volume")), "bars")


BAR = ["symbol", "interval", "ts", "open", "high", "low", "close", "volume"]


def bars(spark: SparkSession, sf_dir: str, interval: str = "1wk") -> DataFrame:
    """Bars of an interval, written once: they are few beside the trades, and most queries read them more than once."""
    return summed(spark, sf_dir, ts=F.date_trunc(UNITS[interval], "ts")).withColumn("interval", F.lit(interval)).select(*BAR)


def all_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of all intervals, rolled up from daily ones of one pass over the trades."""
    day = summed(spark, sf_dir, ts=F.date_trunc("day", "ts"))
    week, month = (rolled_up(day, k, F.date_trunc(UNITS[k], "ts")) for k in ("1wk", "1mo"))
    return day.withColumn("interval", F.lit("1d")).select(*BAR).unionByName(week).unionByName(month)


def finest_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of each symbol, time and line number (symbol, ts, k2, first and last rn), written once; coarser ones are rolled up from them."""
    return summed(spark, sf_dir, ts=F.col("ts"), k2=F.col("k2"))


def rolled_up(finest: DataFrame, interval: str, at: Column) -> DataFrame:
    """Bars of finest ones by a start that is an expression over them."""
    grouped = finest.groupBy("symbol", F.lit(interval).alias("interval"), at.alias("_at")).agg(
        F.min_by("open", "first").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "last").alias("close"), F.sum("volume").alias("volume"),
    )
    return grouped.withColumnRenamed("_at", "ts").select(*BAR)


def stored_bars(spark: SparkSession, sf_dir: str) -> str:
    """Builds the stored table of all intervals' bars and returns its name."""
    return store.save(all_bars(spark, sf_dir), buckets=store.buckets_for(table(spark, sf_dir, "lineitem").count(), spark.sparkContext.defaultParallelism))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    first = part.groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("company"), F.min_by("p_type", "p_partkey").alias("kind"))
    return first.select(F.col("p_brand").alias("symbol"), "company", "kind", instrument(F.col("kind")).alias("instrument_type"))


def instrument(kind):
    return F.when(kind.startswith("ECONOMY"), "ETF").when(kind.startswith("PROMO"), "INDEX").otherwise("EQUITY")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        k.alias("rule_id"), k.alias("user_id"), F.concat(F.lit("Brand#"), brand(k)).alias("symbol"),
        F.when(k % 3 == 0, "1d").when(k % 3 == 1, "1wk").otherwise("1mo").alias("interval"),
        F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        F.when(k % 5 == 0, "ELLIOTT").otherwise("CANDLESTICK").alias("family"), (F.col("c_acctbal") > 0).alias("active"),
    )


def brand(k):
    """The number of one of the 25 brands."""
    return (k % 25 + 1).cast("string")


def congress_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    amount = F.when(price <= 15000, "$1,001 - $15,000").when(price <= 50000, "$15,001 - $50,000").when(price <= 100000, "$50,001 - $100,000").when(price <= 250000, "$100,001 - $250,000").otherwise("$250,001 - $500,000")
    return o.filter(F.col("o_orderstatus").isin("F", "O")).select(
        k.alias("trade_id"), F.col("c_name").alias("member"), F.concat(F.lit("Brand#"), brand(k)).alias("symbol"),
        F.when(F.col("o_orderstatus") == "F", "PURCHASE").otherwise("SALE").alias("trade_type"), amount.alias("amount"),
        F.to_date("o_orderdate").alias("transaction_date"), F.date_add(F.to_date("o_orderdate"), (k % 46).cast("int")).alias("disclosed"),
    )


def insider_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("k4") == F.col("s_suppkey"))
    t = t.filter(F.col("flag").isin("A", "R"))
    return t.select(
        "symbol", F.col("s_name").alias("insider"), F.when(F.col("flag") == "A", "P").otherwise("S").alias("code"),
        F.to_date("ts").alias("filed"), F.col("volume").cast("decimal(24,6)").alias("shares"), F.col("price").cast("decimal(24,6)").alias("price"),
        F.concat_ws("-", F.col("k1").cast("string"), F.col("k2").cast("string"), F.col("k3").cast("string"), F.col("k4").cast("string"), F.col("rn").cast("string")).alias("trade_id"),
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    at = F.date_add(F.lit("1996-01-01").cast("date"), (k % 900).cast("int"))
    return c.select(k.alias("user_id"), F.concat(F.lit("Brand#"), brand(k)).alias("symbol"), (F.col("c_acctbal") > 0).alias("active"), at.alias("activated"), F.when(k % 7 != 0, F.date_add(at, 1)).alias("baseline"))
