"""Windowed aggregates and job state over event streams; the same functions serve batch tables.

These are extensions: recorded jobs are requests, not streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums per event type and window of ``ts``; ``late`` sets the watermark of a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if late else e
    x = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return x.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Events per user and session, which ends after ``gap`` without one."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if late else e
    x = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return x.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def job_store(events: DataFrame, ttl_seconds: int) -> DataFrame:
    """A stream of (job, state, at) to (job, state, status): the last state of each job, kept until ``ttl_seconds`` of
    event time after its first event, then reported as expired and forgotten."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last, _) = state.get
            state.remove()
            yield pd.DataFrame({"job": [key[0]], "state": [last], "status": ["expired"]})
            return
        last, created = state.get if state.exists else (None, None)
        for b in batches:
            for s, at in sorted(zip(b["state"], b["at"]), key=lambda x: x[1]):
                last, created = s, created or int(at.timestamp() * 1000)
        state.update((last, created))
        state.setTimeoutTimestamp(max(created + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job": [key[0]], "state": [last], "status": ["live"]})

    return events.groupBy("job").applyInPandasWithState(update, "job bigint, state string, status string", "state string, created bigint", "update", GroupStateTimeout.EventTimeTimeout)
