"""Structured Streaming: event windows with a watermark, and stateless per-file averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str, key: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and key; batch frames work too (the watermark is then without effect)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def new_peaks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Peaks of Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def average_stream(peaks: DataFrame, digits: int = 2) -> DataFrame:
    """Running weighted mean mass and summed intensity per sample and mass bin."""
    return peaks.groupBy("sample", F.bround("mz", digits).alias("bin")).agg((F.sum(F.col("mz") * F.col("i")) / F.sum("i")).alias("mz"), F.sum("i").alias("i"))
