"""Event-time windows. The same functions run on a batch and on a stream frame.

``ts`` must be a timestamp with the session in UTC; watermarks bound the state of the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, ts: str = "ts", late: str | None = None) -> DataFrame:
    """``ts`` as an instant; with ``late`` also a watermark (streams only)."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return e.withWatermark(ts, late) if late else e


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("about_users")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    s = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), (F.unix_micros("w.end") - F.unix_micros("w.start")).alias("micros"), "n")


def deduped(events: DataFrame, keys: list[str], streaming: bool = False) -> DataFrame:
    """Each key once: within the watermark on a stream."""
    return events.dropDuplicatesWithinWatermark(keys) if streaming else events.dropDuplicates(keys)
