"""The hourly mean of a stream of observations, late data up to the ingestion lag included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LAG_DAYS


def hourly_means(stream: DataFrame, lag: str = f"{LAG_DAYS} days") -> DataFrame:
    """(sid, ts, v) from a stream of (sid, ts, v); an hour is final once the watermark passes it."""
    return stream.withWatermark("ts", lag).groupBy("sid", F.window("ts", "1 hour")).agg(F.avg("v").alias("v")).select("sid", F.col("window.start").alias("ts"), "v")
