"""Fleet-metric windows on a stream.

The same aggregations as :mod:`shardwise.operators.metrics` (G1-G4, G7, G8), made incremental:
a watermark on the event time bounds the state, tumbling windows are emitted
once the watermark passes their end (append mode), and the sustained alarm is
a second, sliding window over the first one's ``window_time`` — chained
stateful operators, each bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import _STATS, _keys, compare, period_seconds


def with_event_time(stream: DataFrame, ts: str, watermark: str = "10 minutes",
                    name: str = "event_time") -> DataFrame:
    """Event time as TIMESTAMP (a watermark needs it; TIMESTAMP_NTZ is read in the session zone)."""
    return stream.withColumn(name, F.col(ts).cast("timestamp")).withWatermark(name, watermark)


def run_arrived(spark: SparkSession, folder: str, schema, build: Callable[[DataFrame], DataFrame],
                output_path: str, checkpoint_path: str, files_per_batch: int | None = None) -> DataFrame:
    """Let a stream over the Parquet objects of ``folder`` handle what has arrived, then stop.

    ``build`` makes the stream's result (append mode), which is added to
    ``output_path``. State, watermark and the objects already read are in
    ``checkpoint_path``, so the next call goes on where this one stopped, and a
    call that was broken off is repeated without double rows. Objects of one
    call are one micro-batch unless ``files_per_batch`` cuts them up. Returns
    what all calls have emitted so far.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", int(files_per_batch))
    emitted = build(reader.parquet(folder))
    query = (emitted.writeStream.outputMode("append").format("parquet")
             .option("path", output_path).option("checkpointLocation", checkpoint_path)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(emitted.schema).parquet(output_path)


def stream_window_stat(stream: DataFrame, ts: str, keys: Sequence[str] | str, value: str,
                       period: int | str = 60, stat: str = "avg", watermark: str = "10 minutes",
                       name: str = "value") -> DataFrame:
    """``window_start, window_end, keys..., name`` per closed window (append mode). [G1-G3]"""
    keys = _keys(keys)
    timed = with_event_time(stream, ts, watermark)
    secs = period_seconds(period)
    return (
        timed.groupBy(F.window("event_time", f"{secs} seconds").alias("__w"), *keys)
        .agg(_STATS[stat.lower()](value).alias(name))
        .select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"),
                *keys, name)
    )


def stream_pivot_metrics(stream: DataFrame, ts: str, keys: Sequence[str] | str, metric: str, value: str,
                         metrics: Sequence[str], period: int | str = 60, stat: str = "avg",
                         watermark: str = "10 minutes") -> DataFrame:
    """Several metrics side by side per closed window (conditional aggregation). [G4]"""
    keys = _keys(keys)
    timed = with_event_time(stream.where(F.col(metric).isin(list(metrics))), ts, watermark)
    secs = period_seconds(period)
    agg = _STATS[stat.lower()]
    return (
        timed.groupBy(F.window("event_time", f"{secs} seconds").alias("__w"), *keys)
        .agg(*[agg(F.when(F.col(metric) == m, F.col(value))).alias(m) for m in metrics])
        .select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"),
                *keys, *metrics)
    )


def stream_threshold_alarm(stream: DataFrame, ts: str, keys, value: str, period=300,
                           threshold: float = 75.0, comparison: str = "<", stat: str = "avg",
                           watermark: str = "10 minutes") -> DataFrame:
    """Closed periods whose statistic breaches the threshold (append mode). [G7]"""
    windows = stream_window_stat(stream, ts, keys, value, period, stat, watermark)
    return windows.where(compare(F.col("value"), comparison, threshold))


def stream_sustained_alarm(stream: DataFrame, ts: str, keys, value: str, period=60,
                           threshold: float = 85.0, comparison: str = ">=", datapoints: int = 5,
                           evaluation_periods: int = 5, stat: str = "avg",
                           watermark: str = "10 minutes") -> DataFrame:
    """Alarms ``keys..., window_start, window_end, breaches`` for the last period of every
    run of ``evaluation_periods`` periods with at least ``datapoints`` breaches. [G8]

    First stage: per-period statistic (tumbling window, watermark). Second stage:
    sliding window of ``evaluation_periods`` periods, sliding by one period, over
    the first stage's ``window_time``; the period that ends the run must have data.
    """
    keys = _keys(keys)
    secs = period_seconds(period)
    timed = with_event_time(stream, ts, watermark)
    first = (
        timed.groupBy(F.window("event_time", f"{secs} seconds").alias("w"), *keys)
        .agg(_STATS[stat.lower()](value).alias("value"))
        .withColumn("breach", compare(F.col("value"), comparison, threshold).cast("int"))
    )
    span = secs * evaluation_periods
    second = (
        first.groupBy(F.window(F.window_time("w"), f"{span} seconds", f"{secs} seconds").alias("run"), *keys)
        .agg(F.sum("breach").alias("breaches"), F.max("w.start").alias("last_start"))
    )
    last = F.col("run.end") - F.expr(f"INTERVAL {secs} SECONDS")
    return (
        second.where((F.col("breaches") >= datapoints) & (F.col("last_start") == last))
        .select(*keys, last.alias("window_start"), F.col("run.end").alias("window_end"),
                F.col("breaches").cast("long").alias("breaches"))
    )
