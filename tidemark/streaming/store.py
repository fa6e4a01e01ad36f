"""A log-structured table for foreachBatch writers.

Each micro-batch adds one epoch of rows, laid out by a range of the key (`part`); every so
many epochs are merged into a snapshot. Readers take the newest snapshot that a marker
names and the epochs after it, and only the parts they ask for. A repeated batch
overwrites its own epoch, a broken-off snapshot has no marker; so neither changes anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Epochs between snapshots.
EVERY = 20


class LogTable:
    """Rows of `schema` under `path`; `part` names the string column of the key's range.
    merge(rows with a column epoch) leaves one row per key; it must not mind what it has merged before."""

    def __init__(self, path: str, schema: StructType, part: str, merge: Callable[[DataFrame], DataFrame], every: int = EVERY):
        self.path, self.part, self.merge, self.every = path, part, merge, every
        self.schema = StructType([f for f in schema.fields if f.name not in (part, "epoch")]).add("epoch", "long").add(part, "string")

    def _read(self, spark: SparkSession, kind: str, keys: str) -> DataFrame:
        return spark.read.schema(StructType([*self.schema.fields[:-1]]).add(keys, "long").add(self.part, "string")).parquet(f"{self.path}/{kind}")

    def create(self, spark: SparkSession) -> None:
        """An empty table."""
        empty = spark.createDataFrame([], self.schema)
        empty.withColumn("batch", F.lit(0).cast("long")).write.mode("append").partitionBy("batch", self.part).parquet(f"{self.path}/epochs")
        empty.withColumn("until", F.lit(0).cast("long")).write.mode("append").partitionBy("until", self.part).parquet(f"{self.path}/snapshots")
        spark.createDataFrame([], "until long").write.mode("append").parquet(f"{self.path}/markers")

    def rows(self, spark: SparkSession, before: int | None = None, parts: DataFrame | None = None) -> DataFrame:
        """The merged rows (of epochs before one; of the parts of a frame alone), with the epoch they are from."""
        marks = spark.read.schema("until long").parquet(f"{self.path}/markers")
        until = (marks if before is None else marks.filter(F.col("until") < before)).agg(F.max("until").alias("m")).first().m
        log = self._read(spark, "epochs", "batch")
        if before is not None:
            log = log.filter(F.col("batch") < before)
        if until is not None:
            log = log.filter(F.col("batch") > until)
        held = log.drop("batch")
        if until is not None:
            held = held.unionByName(self._read(spark, "snapshots", "until").filter(F.col("until") == until).drop("until"))
        if parts is not None:
            # a part is a coarse range (a month, a digit), so their names are few; they prune folders
            held = held.filter(F.col(self.part).isin([r[0] for r in parts.select(self.part).distinct().collect()]))
        return self.merge(held)

    def add(self, new: DataFrame, epoch: int) -> None:
        new = new.withColumns({"epoch": F.lit(epoch).cast("long")}).select(*self.schema.names)
        new.write.mode("overwrite").partitionBy(self.part).parquet(f"{self.path}/epochs/batch={epoch}")
        if epoch and epoch % self.every == 0:
            self.compact(new.sparkSession, epoch)

    def compact(self, spark: SparkSession, until: int) -> None:
        """Merges all up to an epoch into a snapshot, then names it."""
        self.rows(spark, until + 1).select(*self.schema.names).write.mode("overwrite").partitionBy(self.part).parquet(f"{self.path}/snapshots/until={until}")
        spark.range(1).select(F.lit(until).cast("long").alias("until")).write.mode("append").parquet(f"{self.path}/markers")
