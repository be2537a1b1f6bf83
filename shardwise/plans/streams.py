"""Registered stream queries: events arrive in time slices, some late, and every window is emitted once.

The slices stand in for objects that a collector adds to a folder. After each
one the stream is started anew from its checkpoint, handles what has arrived
and stops, so each query also goes through restarts. Late events are late by
less than the watermark and count in their windows; the results are those of
the batch queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import metrics as stream
SLICES = 3
LATE = "INTERVAL 40 MINUTES"
WATERMARK = "1 hour"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/events.parquet")


def _arrivals(spark: SparkSession, d: str) -> list[DataFrame]:
    """The events in slices of arrival: every 20th arrives 40 minutes after its time.

    A closing event far behind the others lets the watermark pass their windows.
    """
    events = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    arrival = F.when(F.col("event_id") % 20 == 0, F.col("ts") + F.expr(LATE)).otherwise(F.col("ts"))
    timed = events.withColumn("arrival", F.coalesce(arrival.cast("double"), F.lit(0.0)))
    lo, hi = timed.where("ts IS NOT NULL").agg(F.min("arrival"), F.max("arrival")).first()
    if lo is None:
        return [events]
    cuts = [lo + (hi - lo) * k / SLICES for k in range(1, SLICES)]
    number = sum(((F.col("arrival") > c).cast("int") for c in cuts), F.lit(0))
    closing = events.select(*[
        (F.max("ts") + F.expr("INTERVAL 7 DAYS")).alias(f.name) if f.name == "ts"
        else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields])
    slices = [timed.where(number == k).drop("arrival") for k in range(SLICES)]
    return [*slices[:-1], slices[-1].unionByName(closing)]


def _streamed(spark: SparkSession, d: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``build``'s stream emits over all slices."""
    folder, out = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    checkpoint = scratch_path(spark, "stream-checkpoint")
    for rows in _arrivals(spark, d):
        rows.write.mode("append").parquet(folder)
        emitted = stream.run_arrived(spark, folder, rows.schema, build, out, checkpoint)
    # Window bounds in the type of the table's times, as the batch queries give them.
    given = _events(spark, d).schema["ts"].dataType
    return emitted.withColumns({
        c: F.col(c).cast(given) for c in ("window_start", "window_end")})


def q_stream_metric_avg_60s(spark, d):
    """Average per user and minute, minutes emitted as the watermark passes them. [G1]"""
    from .catalog import r6

    out = _streamed(spark, d, lambda s: stream.stream_window_stat(
        s, "ts", "user_id", "value", 60, "avg", WATERMARK))
    return out.withColumn("value", r6("value"))


def q_stream_metric_max_60s(spark, d):
    """Greatest value per user, type of event and minute. [G3]"""
    return _streamed(spark, d, lambda s: stream.stream_window_stat(
        s, "ts", ["user_id", "event_type"], "value", 60, "max", WATERMARK))


def q_stream_metric_pivot(spark, d):
    """Hourly averages of several metrics side by side. [G4]"""
    from .catalog import EVENT_TYPES, r6

    # The closing event has to pass the filter on metrics, so it gets the first one's name.
    out = _streamed(spark, d, lambda s: stream.stream_pivot_metrics(
        s.withColumn("event_type", F.coalesce("event_type", F.lit(EVENT_TYPES[0]))), "ts", "user_id",
        "event_type", "value", EVENT_TYPES, 3600, "avg", WATERMARK))
    return out.select("window_start", "window_end", "user_id", *[r6(m).alias(m) for m in EVENT_TYPES])


def q_stream_alarm_low(spark, d):
    """Hours whose average is below the threshold. [G7]"""
    from .catalog import r6

    out = _streamed(spark, d, lambda s: stream.stream_threshold_alarm(
        s, "ts", "event_type", "value", 3600, 35.0, "<", "avg", WATERMARK))
    return out.withColumn("value", r6("value"))


def q_stream_alarm_sustained(spark, d):
    """Five hours in a row above the threshold. [G8]"""
    return _streamed(spark, d, lambda s: stream.stream_sustained_alarm(
        s, "ts", "event_type", "value", 3600, 45.0, ">=", 5, 5, "avg", WATERMARK))


QUERIES = {
    "stream_metric_avg_60s": q_stream_metric_avg_60s,
    "stream_metric_max_60s": q_stream_metric_max_60s,
    "stream_metric_pivot": q_stream_metric_pivot,
    "stream_alarm_low": q_stream_alarm_low,
    "stream_alarm_sustained": q_stream_alarm_sustained,
}
