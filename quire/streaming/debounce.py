"""Time-based behaviour: debounced changes, periodic checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def debounce(events: DataFrame, key: str, ts: str, value: str, quiet_ms: int = 400) -> DataFrame:
    """Of each run of changes no more than quiet_ms apart, the last: batch form, by the gap to the next change."""
    w = Window.partitionBy(key).orderBy(ts, value)
    gap = (F.unix_micros(F.lead(ts).over(w).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1000
    return events.withColumn("gap_ms", gap).where(F.col("gap_ms").isNull() | (F.col("gap_ms") >= quiet_ms)).drop("gap_ms")


def debounce_stream(events: DataFrame, key: str, ts: str, value: str, quiet: str = "400 milliseconds", late: str = "1 minute") -> DataFrame:
    """The same over a stream: sessions that end after the quiet time, with the last value of each, of equal times the greatest."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.col(key), F.session_window(ts, quiet).alias("session"))
        .agg(F.max(F.struct(ts, value))[value].alias(value), F.count("*").alias("changes"))
        .select(key, F.col("session.start").alias("first"), F.col("session.end").alias("until"), value, "changes")
    )


def check_periodically(source: DataFrame, handle, every: str = "24 hours", checkpoint: str | None = None):
    """Start a query that gives each micro-batch to handle(frame, id) on schedule, one at a time."""
    writer = source.writeStream.trigger(processingTime=every).foreachBatch(handle)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def next_check(attempts: DataFrame, started: DataFrame, key: str, ts: str, every: str = "24 hours", first: str = "10 seconds") -> DataFrame:
    """(key, due): when each key of started (key, ts) is to be checked next: some time after its last attempt, failed ones too, or soon after its start."""
    last = attempts.groupBy(key).agg(F.max(ts).alias("_last"))
    due = F.coalesce(F.col("_last") + F.expr(f"interval {every}"), F.col(ts) + F.expr(f"interval {first}"))
    return started.join(last, key, "left").select(key, due.alias("due"))
