"""Chunked numbers and moving sums against windows over whole groups."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.chunked import chunk_groups, moving_sums, whole_groups


def expected(df, reach):
    w = Window.partitionBy("k").orderBy("t", "u")
    return df.select("k", "t", "u", "v", F.row_number().over(w).cast("long").alias("rn"), F.sum("v").over(w.rowsBetween(-(reach - 1), 0)).alias("moving"))


@pytest.mark.parametrize(("reach", "width"), [(2, 3), (7, 1), (7, 5), (40, 4), (40, 1000)])
def test_equals_whole_windows(spark, reach, width):
    """Chunks smaller and larger than the reach, gaps, a hot group, a group of one row."""
    r = random.Random(reach * width)
    rows = [("hot" if r.random() < 0.5 else r.choice("abc"), r.choice([r.randint(0, 20), r.randint(0, 300)]), i, r.randint(-200, 200)) for i in range(900)] + [("one", 5, 1, 7)]
    df = spark.createDataFrame(rows, "k string, t long, u long, v long")
    got = moving_sums(df.withColumn("c", F.floor(F.col("t") / width)), "k", "c", ["t", "u"], "v", reach).drop("c")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected(df, reach).collect()))


def test_rows_are_dealt_by_chunk(spark):
    df = spark.createDataFrame([("a", 1, 2, 3)], "k string, t long, u long, v long").withColumn("c", F.col("t"))
    plan = moving_sums(df, "k", "c", ["t", "u"], "v", 5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and moving_sums(df.limit(0), "k", "c", ["t", "u"], "v", 5).count() == 0
    with pytest.raises(ValueError):
        moving_sums(df, "k", "c", ["t", "u"], "v", 1)


@pytest.mark.parametrize(("reach", "width"), [(2, 3), (7, 1), (7, 5), (40, 4), (40, 1000)])
def test_groups_equal_grouped_windows(spark, reach, width):
    """Groups that lie in several chunks, a key without a name, and rows that are read once."""
    r = random.Random(reach * width + 1)
    rows = [("hot" if r.random() < 0.5 else r.choice(["a", "b", None]), r.choice([r.randint(0, 20), r.randint(0, 300)]), i, r.randint(-200, 200)) for i in range(900)] + [("one", 5, 1, 7)]
    df = spark.createDataFrame(rows, "k string, t long, u long, v long")
    groups = chunk_groups(df.withColumn("c", F.floor(F.col("t") / width)), "k", "c", ["t", "u"], "v", reach, {"g": F.floor(F.col("t") / 7)}, "u")
    plan = groups._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1 == plan.count("Scan ExistingRDD")
    got = whole_groups(groups, "k", "c", reach, ["g"])
    want = expected(df, reach).groupBy("k", F.floor(F.col("t") / 7).alias("g")).agg(
        F.min("rn"), F.max("rn"), F.min_by("moving", "rn"), F.max("moving"), F.min("moving"), F.max_by("moving", "rn"), F.sum("u"),
    )
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
