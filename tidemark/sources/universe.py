"""Universe manifests: tab-separated lists of a study's symbols, their counts and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The manifest's columns.
COLUMNS = ("symbol", "name", "sector", "cap_tier", "cohort", "role", "first_date", "last_date", "daily_candles", "market_cap_usd")
ROLES = ("DEVELOPMENT", "HOLDOUT", "VALIDATION")
GROUPS = ("role", "cap_tier", "cohort")


def write_manifest(universe: DataFrame, path: str) -> None:
    """The manifest as tab-separated text with a header, in ranges of symbols."""
    df = universe.select(*[F.col(c).cast("string").alias(c) for c in COLUMNS])
    df.repartitionByRange("symbol").sortWithinPartitions("symbol").write.options(sep="\t", header=True, emptyValue="", nullValue="").csv(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a manifest and `good`: ten fields, a symbol, a known role, dates and candles that parse
    (a market value may be missing). Another header is an error; blank lines are left out; bad rows
    are kept, so that they can be counted."""
    schema = ", ".join(f"{c} string" for c in (*COLUMNS, "_bad"))
    rows = spark.read.schema(schema).options(sep="\t", header=True, enforceSchema=False, columnNameOfCorruptRecord="_bad", mode="PERMISSIVE", quote="").csv(path)
    typed = {"first_date": "date", "last_date": "date", "daily_candles": "long", "market_cap_usd": "long"}
    parsed = rows.select(*[F.col(c).try_cast(typed[c]).alias(c) if c in typed else F.col(c) for c in COLUMNS], F.col("_bad"), F.col("market_cap_usd").alias("_cap"))
    fine = F.col("_bad").isNull() & (F.col("symbol") != "") & F.col("role").isin(*ROLES) & F.col("first_date").isNotNull() & F.col("last_date").isNotNull() & F.col("daily_candles").isNotNull()
    fine = fine & ((F.coalesce(F.trim("_cap"), F.lit("")) == "") | F.col("market_cap_usd").isNotNull())
    return parsed.select(*COLUMNS, F.coalesce(fine, F.lit(False)).alias("good"))


def counts(manifest: DataFrame, core: DataFrame) -> DataFrame:
    """Per role, cap tier and cohort (kind, value) and for all (kind ALL, value ALL): rows, distinct symbols,
    bad rows, daily candles and how many distinct symbols the core list (column symbol) has too.

    A manifest is sound where rows equal symbols and bad and shared are 0."""
    held = manifest.join(core.select("symbol").distinct().withColumn("_core", F.lit(True)), "symbol", "left")
    kinds = [F.struct(F.lit("ALL").alias("kind"), F.lit("ALL").alias("value")), *[F.struct(F.lit(g).alias("kind"), F.coalesce(g, F.lit("")).alias("value")) for g in GROUPS]]
    each = held.select("symbol", "good", "daily_candles", "_core", F.explode(F.array(*kinds)).alias("k"))
    return each.groupBy("k.kind", "k.value").agg(
        F.count("*").alias("rows"), F.count_distinct("symbol").alias("symbols"), F.count_if(~F.col("good")).alias("bad"),
        F.coalesce(F.sum("daily_candles"), F.lit(0)).alias("daily_candles"), F.count_distinct(F.when(F.col("_core"), F.col("symbol"))).alias("shared"),
    )
