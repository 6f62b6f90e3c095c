"""Structured Streaming over events: an extension, not part of the batch inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling windows with a watermark; the same code takes a batch or a stream."""
    ts = events.withColumn("__ts", F.col(time).cast("timestamp"))
    ts = ts.withWatermark("__ts", late) if events.isStreaming else ts
    return ts.groupBy(F.window("__ts", size).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
