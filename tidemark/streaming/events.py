"""Streaming forms: watermarked windows over events, scored pages as a stream, queue-empty timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS.replace("ts timestamp", "ts timestamp_ntz")).option("maxFilesPerTrigger", per_trigger).parquet(path).withColumn(
        "ts", F.col("ts").cast("timestamp")
    )


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; works on streams (late rows dropped) and on tables alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def idle_queues(events: DataFrame, timeout_ms: int) -> DataFrame:
    """(queue, idle_since): queues whose last event was an empty pop and that stayed silent for the timeout.

    ``events``: (queue, kind, ts). Any other event disarms the timer.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            since = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], since)], columns=["queue", "idle_since"])
            return
        since = state.get[0] if state.exists else None
        for batch in batches:
            for kind, ts in batch.sort_values("ts")[["kind", "ts"]].itertuples(index=False):
                since = (since or ts) if kind == "empty" else None
        if since is None:
            if state.exists:
                state.remove()
            return
        state.update((since,))
        state.setTimeoutDuration(timeout_ms)

    return events.groupBy("queue").applyInPandasWithState(
        step, "queue string, idle_since timestamp", "since timestamp", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
