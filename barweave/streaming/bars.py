"""Bars from an event stream: windowed aggregation under a watermark, appended to the lake batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def bars(events: DataFrame, width: str = "1 day", late: str = "3 days", key: str = "event_type") -> DataFrame:
    """(security_id, date, open, high, low, close, volume, retrieved_at) of events (ts, value, key), batch or stream.

    Events later than ``late`` are left out of a stream's bars; corrections come as new rows
    that win by retrieved_at.
    """
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    df = df.withWatermark("ts", late) if events.isStreaming else df
    out = df.groupBy(F.window("ts", width).alias("w"), F.col(key).alias("security_id")).agg(
        F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value")
            .alias("low"), F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count("*").cast("double")
                .alias("volume"), F.max("ts").alias("retrieved_at")
    )
    return out.select("security_id", F.col("w.start").cast("date")
        .alias("date"), "open", "high", "low", "close", "volume", "retrieved_at")


def append_to(stream: DataFrame, sink: Callable[[DataFrame], object], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand each micro-batch to ``sink`` (a lake's append); the checkpoint makes restarts resume."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: sink(df))
    return (writer.trigger(availableNow=True) if once else writer).start()
