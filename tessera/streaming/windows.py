"""Streaming forms of the event panel: an extension beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the event files below ``path`` with the schema of what lies there; ts becomes an instant."""
    files = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def bars(events: DataFrame, size: str = "1 day", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Open, high, low, close and volume per user and window; events later than ``late`` are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), F.col("user_id").alias("entity")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("vol"))
    return g.select("entity", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "vol")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Events and value per user and session."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), F.col("user_id").alias("entity")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select("entity", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")
