"""Raw events to bars, over a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(events: DataFrame, key: str, stamp: str, value: str, tie: str, interval: str, watermark: str | None = None) -> DataFrame:
    """``series_id, bar_time, open, high, low, close, volume`` per key and interval of event time; volume counts
    events. ``tie`` orders events of one stamp. With ``watermark`` a stream keeps an interval open for late
    events that long and then emits it once (append mode); its state is one row per open interval."""
    e = events.where(F.col(value).isNotNull() & F.col(stamp).isNotNull())
    if watermark:
        e = e.withWatermark(stamp, watermark)
    at = F.struct(stamp, tie)
    g = e.groupBy(F.col(key).alias("series_id"), F.window(stamp, interval).alias("_w")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return g.select("series_id", F.col("_w.start").alias("bar_time"), "open", "high", "low", "close", "volume")


def first_copies(readings: DataFrame, keys: list[str], stamp: str, watermark: str) -> DataFrame:
    """A stream of readings without those delivered again within the watermark."""
    return readings.withWatermark(stamp, watermark).dropDuplicatesWithinWatermark(keys)
