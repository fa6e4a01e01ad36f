"""Ingest, repair and paging of bars and disclosures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.indicators import W

KEY = ["symbol", "interval", "ts"]
VALUES = ["open", "high", "low", "close", "volume"]


def scan_bars(bars: DataFrame, symbols=None, interval=None, start=None, end=None) -> DataFrame:
    """A slice by symbol, interval and [start, end): filters that reach the scan."""
    df = bars
    if symbols:
        df = df.filter(F.col("symbol").isin(*symbols))
    if interval:
        df = df.filter(F.col("interval") == interval)
    if start:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    return df.filter(F.col("ts") < F.lit(end).cast("timestamp")) if end else df


def complete(bars: DataFrame) -> DataFrame:
    return bars.dropna(subset=["ts", "open", "high", "low", "close"])


def valid(bars: DataFrame, positive: bool = False) -> DataFrame:
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    ok = ~(F.isnan(o) | F.isnan(h) | F.isnan(low) | F.isnan(c)) & (h >= F.greatest(o, c)) & (low <= F.least(o, c))
    return complete(bars).filter(ok & (low > 0) if positive else ok)


def canonical_ts(interval: Column, ts: Column) -> Column:
    return F.when(interval == "1d", F.date_trunc("day", ts)).when(interval == "1wk", F.date_trunc("week", ts)).when(interval == "1mo", F.date_trunc("month", ts)).otherwise(ts)


def dedupe_logical(bars: DataFrame, order: str = "id") -> DataFrame:
    """The newest row (largest `order`) of each symbol, interval and period."""
    df = bars.withColumn("_at", canonical_ts(F.col("interval"), F.col("ts")))
    w = Window.partitionBy("symbol", "interval", "_at").orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "ts").withColumnRenamed("_at", "ts")


def canonical_monthly(bars: DataFrame) -> DataFrame:
    return bars.filter((F.col("interval") != "1mo") | (F.dayofmonth("ts") == 1))


def infer_interval(bars: DataFrame) -> DataFrame:
    """Per symbol the interval of its upper median gap: up to 4 days daily, up to 14 weekly, else monthly."""
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts")))
    g = bars.select("symbol", gap.alias("gap")).filter("gap > 0").groupBy("symbol", "gap").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("symbol").orderBy("gap"))
    g = g.withColumns({"upto": upto, "all": F.sum("n").over(Window.partitionBy("symbol"))})
    m = g.groupBy("symbol").agg(F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("gap"))).alias("gap"))
    return m.select("symbol", "gap", F.when(F.col("gap") <= 4 * 86400, "1d").when(F.col("gap") <= 14 * 86400, "1wk").otherwise("1mo").alias("interval"))


def mixed_intervals(bars: DataFrame) -> DataFrame:
    """Symbols whose rows declare several intervals."""
    return bars.groupBy("symbol").agg(F.count_distinct("interval").alias("n")).filter("n > 1")


def completed(bars: DataFrame, asof: str, zone: str = "Europe/Brussels") -> DataFrame:
    """Bars before the first incomplete period at an instant (UTC); a week is
    complete from Saturday in the zone."""
    local = F.from_utc_timestamp(F.lit(asof).cast("timestamp"), zone)
    week = F.when(F.weekday(local) >= 5, F.date_trunc("week", local) + F.expr("INTERVAL 7 DAYS")).otherwise(F.date_trunc("week", local))
    edge = F.when(F.col("interval") == "1d", F.date_trunc("day", local)).when(F.col("interval") == "1wk", week).otherwise(F.date_trunc("month", local))
    return bars.filter(F.col("ts") < edge)


def latest_n(bars: DataFrame, n: int, before: str | None = None) -> DataFrame:
    df = scan_bars(bars, end=before)
    w = Window.partitionBy("symbol", "interval").orderBy(F.desc("ts"))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def keyset_page(bars: DataFrame, symbol: str, interval: str, before: str, limit: int) -> DataFrame:
    """The page of `limit` bars before a cursor, with the next cursor and has_more."""
    held = scan_bars(bars, [symbol], interval, end=before).orderBy(F.desc("ts")).limit(limit + 1)
    w = Window.orderBy(F.desc("ts"))  # a page
    df = held.withColumn("_n", F.row_number().over(w))
    more = df.agg((F.count("*") > limit).alias("has_more"), F.min(F.when(F.col("_n") <= limit, F.col("ts"))).alias("next_cursor"))
    return df.filter(F.col("_n") <= limit).drop("_n").join(F.broadcast(more))


def changed_upsert(stored: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Inserted or changed rows alone, with `change`; the batch's last row of a key wins."""
    last = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc(order)))).filter("_n = 1").drop("_n", order)
    old = stored.select(*KEY, F.lit(True).alias("_had"), *[F.col(c).alias(f"_{c}") for c in VALUES])
    df = last.join(old, KEY, "left")
    same = F.lit(True)
    for c in VALUES:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    change = F.when(F.col("_had").isNull(), "INSERT").when(~same, "UPDATE")
    return df.withColumn("change", change).filter("change IS NOT NULL").select(*KEY, *VALUES, "change")


def provider_fallback(primary: DataFrame, secondary: DataFrame, size: int) -> DataFrame:
    """Per symbol and interval the primary page, unless it is shorter than `size`
    and the secondary one is longer."""
    both = primary.withColumn("provider", F.lit("primary")).unionByName(secondary.withColumn("provider", F.lit("secondary")))
    n = both.groupBy("symbol", "interval", "provider").agg(F.count("*").alias("n"))
    full = (F.col("provider") == "primary") & (F.col("n") >= size)
    w = Window.partitionBy("symbol", "interval").orderBy(F.desc(full), F.desc("n"), "provider")
    chosen = n.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("symbol", "interval", "provider")
    return both.join(chosen, ["symbol", "interval", "provider"], "left_semi")


def disclosure_upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merged by (provider, fingerprint): first_seen kept, last_seen and attributes refreshed, inserted flagged."""
    k = ["provider", "fingerprint"]
    a, b = stored.alias("a"), incoming.alias("b")
    df = a.join(b, k, "full")
    return df.select(*k, F.coalesce("b.amount", "a.amount").alias("amount"), F.least("a.first_seen", "b.first_seen").alias("first_seen"), F.greatest("a.last_seen", "b.last_seen").alias("last_seen"), F.col("a.first_seen").isNull().alias("inserted"))


def parallel_arrays(payloads: DataFrame, keep: int) -> DataFrame:
    """Bars of landed payloads with parallel arrays: symbol, interval and json."""
    shape = "struct<timestamp:array<bigint>,open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<bigint>>"
    p = F.from_json("json", shape)
    df = payloads.select("symbol", "interval", F.inline(F.arrays_zip(*[p[c].alias(c) for c in ("timestamp", *VALUES)])))
    df = df.withColumn("ts", canonical_ts(F.col("interval"), F.timestamp_seconds("timestamp"))).drop("timestamp")
    return latest_n(canonical_monthly(valid(df, positive=True)), keep)


def object_rows(payloads: DataFrame, before: str) -> DataFrame:
    """Bars of landed payloads `values:[{datetime, open, ...}]` of strings; a missing number is 0."""
    shape = "struct<values:array<struct<datetime:string,open:string,high:string,low:string,close:string,volume:string>>>"
    df = payloads.select("symbol", "interval", F.explode(F.from_json("json", shape)["values"]).alias("v"))
    number = lambda c: F.coalesce(F.col(f"v.{c}").try_cast("double"), F.lit(0.0))
    df = df.select("symbol", "interval", F.col("v.datetime").try_cast("timestamp").alias("ts"), *[number(c).alias(c) for c in VALUES[:4]], F.coalesce(F.col("v.volume").try_cast("bigint"), F.lit(0)).alias("volume"))
    return df.filter(F.col("ts") < F.lit(before).cast("timestamp"))


def universe(bars: DataFrame, least_bars: int, least_days: int) -> DataFrame:
    """Symbols with enough clean history: first, last, bars and cohort by last date."""
    bad = ~((F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")) & (F.col("low") > 0))
    g = bars.groupBy("symbol").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("bars"), F.coalesce(F.bool_or(bad), F.lit(True)).alias("bad"))
    g = g.filter((F.col("bars") >= least_bars) & (F.datediff("last", "first") >= least_days) & ~F.col("bad")).drop("bad")
    return g.withColumn("cohort", F.when(F.col("last") >= F.lit("2001-10-01").cast("timestamp"), "ACTIVE").otherwise("ENDED"))


def latest_quote(bars: DataFrame) -> DataFrame:
    """Newest close per symbol and its change in per cent against the close before (its own open, if alone)."""
    before = F.lag("close").over(W())
    newest = F.lead("ts").over(W()).isNull()
    df = bars.withColumns({"_b": F.coalesce(before, F.col("open")), "_new": newest}).filter("_new")
    return df.select("symbol", "interval", "ts", "close", F.round((F.col("close") - F.col("_b")) / F.col("_b") * 100, 6).alias("change"))
