"""The stored bar table: same bars, and plans that use its layout."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ingest as G
from tidemark.sources import market as M
from tidemark.sources import store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def name(spark):
    return store.save(M.all_bars(spark, SF), buckets=4)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_holds_the_bars(spark, name):
    for interval in M.UNITS:
        got = store.of_interval(spark, name, interval).select(*M.BAR)
        assert sorted(got.collect()) == sorted(M.bars(spark, SF, interval).collect())


def test_scan_prunes_partitions_buckets_and_time(spark, name):
    scan = lambda: G.scan_bars(store.read(spark, name), ["Brand#1"], "1wk", "1996-01-01", "1999-01-01")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # shows the buckets in the plan
    try:
        text = plan(scan())
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert len(scan().select(F.input_file_name()).distinct().collect()) == 1
    assert re.search(r"PartitionFilters: \[[^\]]*interval[^\]]*= 1wk", text)
    assert "SelectedBucketsCount: 1 out of 4" in text
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", text)


def test_windows_and_joins_need_no_exchange(spark, name):
    bars = store.of_interval(spark, name, "1d")
    w = Window.partitionBy("symbol", "interval").orderBy("ts")
    numbered = bars.withColumn("idx", F.row_number().over(w))
    assert "Exchange" not in plan(numbered)
    after = numbered.select("symbol", "interval", (F.col("idx") - 1).alias("idx"), F.col("close").alias("next"))
    with_next = numbered.hint("merge").join(after, ["symbol", "interval", "idx"])
    grouped = store.read(spark, name).groupBy("symbol", "interval").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        assert "Exchange" not in plan(with_next) and "Exchange" not in plan(grouped)
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    assert with_next.count() == numbered.count() - bars.select("symbol").distinct().count()


def test_dimension_filters_prune_partitions_at_run_time(spark, name):
    wanted = spark.createDataFrame([("Brand#1", "1mo", 3), ("Brand#2", "1d", 4)], "symbol string, interval string, n int").filter("n < 4")
    text = plan(store.read(spark, name).join(F.broadcast(wanted), ["symbol", "interval"]))
    assert "dynamicpruning" in text


def test_append_and_overwrite(spark):
    one = M.bars(spark, SF, "1mo").filter("symbol = 'Brand#1'")
    name = store.save(one, buckets=2)
    store.save(M.bars(spark, SF, "1mo").filter("symbol = 'Brand#2'"), name, 2, "append")
    assert {r.symbol for r in store.read(spark, name).select("symbol").distinct().collect()} == {"Brand#1", "Brand#2"}
    store.save(one, name, 2, "overwrite")
    assert store.read(spark, name).count() == one.count()
    empty = store.save(one.limit(0), buckets=2)
    assert store.read(spark, empty).count() == 0
    assert (store.buckets_for(10, 8), store.buckets_for(10**9, 8), store.buckets_for(10**15, 8)) == (8, 50, store.MOST_BUCKETS)
