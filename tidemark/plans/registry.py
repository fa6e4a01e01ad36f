"""All registered queries of the market-signal operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import alerts, elliott, indicators, ingest, joins, live, patterns, signals  # noqa: F401
from tidemark.plans.catalog import ORACLES, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.engulfing_report(spark, sf_dir)
