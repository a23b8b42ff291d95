"""Streaming twins of the trend operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", watermark: str | None = None) -> DataFrame:
    """(day, kind, events, total) by tumbling days; on a stream with a watermark a day is final once that has passed it.

    The sum is of 4-digit decimals, so it doesn't depend on the order of arrival.
    """
    if watermark:
        # A watermark needs an instant; a local time is taken as one of the session's zone.
        events = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    total = F.sum(F.round(F.col(value), 4).cast("decimal(18,4)")).alias("total")
    days = events.groupBy(F.window(ts, "1 day"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("events"), total)
    return days.select(F.col("window.start").cast("date").alias("day"), "kind", "events", F.col("total").cast("decimal(28,4)").alias("total"))


def monthly_updates(events: DataFrame, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """(month, kind, events) as an updating aggregate: a window can't be a month long."""
    return events.groupBy(F.trunc(ts, "month").alias("month"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("events"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that its source holds now, into a table in memory."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
