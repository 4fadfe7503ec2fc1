"""Runs of activity in a stream of events, closed by a timeout on event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(events: DataFrame, timeout: str = "90 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, started, ended, beats, errors) of each user's sessions; works on a stream (append mode) and on a table alike."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return (
        marked.groupBy("user_id", F.session_window("ts", timeout).alias("w"))
        .agg(F.count(F.lit(1)).alias("beats"), F.sum((F.col("event_type") == "error").cast("long")).alias("errors"))
        .select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "beats", "errors")
    )
