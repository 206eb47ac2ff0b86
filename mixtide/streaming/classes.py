"""Class counts of a stream: additive, so a stream keeps them per window and any batch can be refitted from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(ts, event_type, value) -> window start, event_type, observed, positive; works on streams and on tables."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    call = F.col("value") > 50
    return marked.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("value").alias("observed"), F.sum(call.cast("long")).alias("positive")).select(F.col("w.start").alias("window_start"), "event_type", "observed", "positive")
