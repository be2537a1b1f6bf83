"""Fleet-metric queries: per-entity time-window statistics, pivots, alarms, latest rows.

Input is any table with an entity key, an event time and a value (for
example ``entity, metric, ts, value``). Windows are tumbling and aligned to the
epoch. Every aggregation is keyed on ``(window, entity...)``, so partial
aggregation collapses each task's rows before the shuffle and a hot entity is
still spread over many windows. The sustained alarm ("m of n consecutive
periods breach") avoids a per-entity window function: every breaching period
is fanned out to the ``n`` periods whose evaluation it takes part in, and a
second aggregation counts breaches per (entity, period).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STATS = {"avg": F.avg, "average": F.avg, "min": F.min, "minimum": F.min, "max": F.max,
          "maximum": F.max, "sum": F.sum, "count": F.count, "samplecount": F.count}

# Comparison operators by symbol and by the monitoring service's names.
_COMPARE = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "LessThanThreshold": lambda a, b: a < b,
    "LessThanOrEqualToThreshold": lambda a, b: a <= b,
    "GreaterThanThreshold": lambda a, b: a > b,
    "GreaterThanOrEqualToThreshold": lambda a, b: a >= b,
}

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def period_seconds(period: int | str) -> int:
    """``60``, ``"60 seconds"``, ``"5 minutes"``, ``"1 hour"`` -> seconds."""
    if isinstance(period, int):
        return period
    m = re.fullmatch(r"\s*(\d+)\s*(second|minute|hour|day)s?\s*", period.lower())
    if not m:
        raise ValueError(f"unsupported period {period!r}")
    return int(m.group(1)) * _UNIT_SECONDS[m.group(2)]


def _period(period: int | str) -> str:
    return f"{period_seconds(period)} seconds"


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def window_stat(df: DataFrame, ts: str, keys: Sequence[str] | str, value: str,
                period: int | str = 60, stat: str = "avg", name: str = "value") -> DataFrame:
    """``window_start, window_end, keys..., name`` = ``stat(value)`` per key and period. [G1-G3]

    A period without rows gives no row (missing data stays missing).
    """
    keys = _keys(keys)
    agg = _STATS[stat.lower()]
    return (
        df.groupBy(F.window(ts, _period(period)).alias("__w"), *keys)
        .agg(agg(value).alias(name))
        .select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"),
                *keys, name)
    )


def restrict(df: DataFrame, instances: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Keep rows of the listed entities (left semi join; AQE broadcasts a small list). [G5]"""
    return df.join(instances, _keys(on), "left_semi")


def pivot_metrics(df: DataFrame, ts: str, keys: Sequence[str] | str, metric: str, value: str,
                  metrics: Sequence[str], period: int | str = 60, stat: str = "avg") -> DataFrame:
    """Several metrics side by side: one column per metric name, ``stat`` per key and period. [G4]

    The metric filter reaches the scan; the pivot is conditional aggregation in
    one pass (no distinct-values job).
    """
    keys = _keys(keys)
    agg = _STATS[stat.lower()]
    return (
        df.where(F.col(metric).isin(list(metrics)))
        .groupBy(F.window(ts, _period(period)).alias("__w"), *keys)
        .agg(*[agg(F.when(F.col(metric) == m, F.col(value))).alias(m) for m in metrics])
        .select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"),
                *keys, *metrics)
    )


def latest(df: DataFrame, ts: str, fields: Sequence[str], n: int = 20,
           tiebreak: Sequence[str] = ()) -> DataFrame:
    """The ``n`` newest rows, newest first (a top-k: each task keeps ``n`` rows). [G6]"""
    order = [F.col(ts).desc()] + [F.col(c).desc() for c in tiebreak]
    return df.orderBy(*order).limit(n).select(*fields)


def compare(col: Column, comparison: str, threshold: float) -> Column:
    return _COMPARE[comparison](col, F.lit(threshold))


def threshold_alarm(df: DataFrame, ts: str, keys: Sequence[str] | str, value: str,
                    period: int | str = 300, threshold: float = 75.0, comparison: str = "<",
                    stat: str = "avg") -> DataFrame:
    """Periods whose statistic breaches the threshold (one evaluation period). [G7]"""
    windows = window_stat(df, ts, keys, value, period, stat)
    return windows.where(compare(F.col("value"), comparison, threshold))


def sustained_alarm(df: DataFrame, ts: str, keys: Sequence[str] | str, value: str,
                    period: int | str = 60, threshold: float = 85.0, comparison: str = ">=",
                    datapoints: int = 5, evaluation_periods: int = 5,
                    stat: str = "avg") -> DataFrame:
    """Periods ``t`` where at least ``datapoints`` of the ``evaluation_periods`` periods
    ending at ``t`` have data that breaches; ``t`` itself must have data. [G8]

    Every period with data marks itself present; a breaching period also counts
    toward the ``evaluation_periods - 1`` periods after it. One aggregation per
    ``(keys, period)`` then gives the breach count, from a single scan.
    Output: ``keys..., window_start, window_end, breaches``.
    """
    keys = _keys(keys)
    secs = period_seconds(period)
    windows = window_stat(df, ts, keys, value, secs, stat)
    breach = compare(F.col("value"), comparison, threshold)
    fanned = (
        windows.select(*keys, "window_start", F.coalesce(breach, F.lit(False)).alias("__b"),
                       F.explode(F.sequence(F.lit(0), F.lit(evaluation_periods - 1))).alias("__k"))
        .where((F.col("__k") == 0) | F.col("__b"))
        .select(*keys,
                F.expr(f"timestampadd(SECOND, __k * {secs}, window_start)").alias("window_start"),
                F.col("__b").cast("int").alias("__b"),
                (F.col("__k") == 0).alias("__own"))
    )
    alarms = (
        fanned.groupBy(*keys, "window_start")
        .agg(F.sum("__b").alias("breaches"), F.max("__own").alias("__present"))
        .where(F.col("__present") & (F.col("breaches") >= F.lit(datapoints)))
    )
    return alarms.select(
        *keys, "window_start",
        F.expr(f"timestampadd(SECOND, {secs}, window_start)").alias("window_end"),
        F.col("breaches").cast("long").alias("breaches"))
