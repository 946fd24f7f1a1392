"""A store that is brought up to date: a table in partitions, and a manifest that says from what each was made.

A partition is done if the manifest holds its key with the digest of its present input and of the options. What is
pending is a set difference of keys; only that is made, and its partitions alone are overwritten. The manifest is
appended last, so a run that is cut off leaves its partitions pending.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "key string, digest string, options string, run long"


def options_digest(options: dict) -> str:
    return hashlib.sha256(json.dumps(options, sort_keys=True, default=str).encode()).hexdigest()


def input_digests(rows: DataFrame, by: str) -> DataFrame:
    """key and digest of each partition's rows: their number and an exclusive or of their hashes, so no order matters."""
    columns = sorted(rows.columns)
    return rows.groupBy(F.col(by).cast("string").alias("key")).agg(
        F.concat_ws(":", F.count("*"), F.hex(F.bit_xor(F.xxhash64(*columns))), F.hex(F.sum(F.pmod(F.xxhash64(*columns, F.lit(7)), F.lit(1 << 40))))).alias("digest"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class Store:
    """The table at ``path``, a folder for each value of ``by``, and its manifest beside it."""

    def __init__(self, spark: SparkSession, path: str, by: str, options: dict | None = None):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        self.options = options_digest({"by": by, **(options or {})})

    @property
    def log(self) -> str:
        return f"{self.path}_manifest"

    def manifest(self) -> DataFrame:
        """The last entry of each key."""
        if not exists(self.spark, self.log):
            return self.spark.createDataFrame([], MANIFEST)
        d = self.spark.read.schema(MANIFEST).parquet(self.log)
        return d.groupBy("key").agg(F.max_by(F.struct("digest", "options", "run"), "run").alias("x")).select("key", "x.*")

    def pending(self, inputs: DataFrame) -> DataFrame:
        """key and digest of the partitions of ``inputs`` that are not done."""
        done = self.manifest().where(F.col("options") == self.options).select("key", "digest")
        return input_digests(inputs, self.by).join(done, ["key", "digest"], "left_anti")

    def gone(self, inputs: DataFrame) -> DataFrame:
        """Keys that are stored and have no input any more."""
        return self.manifest().select("key").exceptAll(inputs.select(F.col(self.by).cast("string").alias("key")).distinct())

    def update(self, inputs: DataFrame, make: Callable[[DataFrame], DataFrame]) -> list[str]:
        """Makes what is pending and returns its keys. ``make`` gets the pending keys (a frame with the column ``by``) and
        returns the rows of these partitions, for which it may read any history. Partitions without input go."""
        spark = self.spark
        pending = self.pending(inputs).persist()
        try:
            todo = [r["key"] for r in pending.select("key").orderBy("key").collect()]
            run = (self.manifest().agg(F.max("run")).first()[0] or 0) + 1
            if todo:
                keys = inputs.select(self.by).distinct().join(pending.select(F.col("key").alias("__key")), F.col(self.by).cast("string") == F.col("__key"), "left_semi")
                rows = make(keys)
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.by).parquet(self.path)
            gone = self.gone(inputs).select("key", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("options"), F.lit(run).cast("long").alias("run"))
            entries = pending.select("key", "digest", F.lit(self.options).alias("options"), F.lit(run).cast("long").alias("run")).unionByName(gone)
            if todo or not gone.isEmpty():
                entries.coalesce(1).write.mode("append").parquet(self.log)
            return todo
        finally:
            pending.unpersist()

    def read(self) -> DataFrame:
        """Rows of the partitions that are done under these options."""
        done = self.manifest().where(F.col("options") == self.options).select(F.col("key").alias("__key"))
        d = self.spark.read.parquet(self.path)
        return d.join(F.broadcast(done), F.col(self.by).cast("string") == F.col("__key"), "left_semi")
