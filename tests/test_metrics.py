import datetime as dt
from collections import defaultdict

import pytest

from shardwise.operators import metrics

from .conftest import TESTDATA

T0 = dt.datetime(2024, 1, 1)


def series(spark, points):
    rows = [(e, T0 + dt.timedelta(seconds=s), float(v)) for e, s, v in points]
    return spark.createDataFrame(rows, "entity STRING, ts TIMESTAMP_NTZ, value DOUBLE")


def test_period_parsing():
    assert metrics.period_seconds(60) == 60
    assert metrics.period_seconds("5 minutes") == 300
    assert metrics.period_seconds("1 hour") == 3600
    with pytest.raises(ValueError):
        metrics.period_seconds("fortnight")


def test_window_stats(spark):
    df = series(spark, [("a", 5, 10), ("a", 30, 20), ("a", 65, 40), ("b", 1, 7)])
    avg = {(r["entity"], r["window_start"]): r["value"]
           for r in metrics.window_stat(df, "ts", "entity", "value", 60).collect()}
    assert avg == {("a", T0): 15.0, ("a", T0 + dt.timedelta(minutes=1)): 40.0, ("b", T0): 7.0}
    mn = metrics.window_stat(df, "ts", "entity", "value", 60, "min").where("entity = 'a'").orderBy("window_start")
    assert [r["value"] for r in mn.collect()] == [10.0, 40.0]


def test_pivot_two_metrics(spark):
    rows = [("i1", "mem", T0, 50.0), ("i1", "swap", T0, 5.0), ("i1", "mem", T0, 70.0)]
    df = spark.createDataFrame(rows, "entity STRING, metric STRING, ts TIMESTAMP_NTZ, value DOUBLE")
    r = metrics.pivot_metrics(df, "ts", "entity", "metric", "value", ["mem", "swap"], 60).first()
    assert (r["mem"], r["swap"]) == (60.0, 5.0)


def test_restrict_and_latest(spark):
    df = series(spark, [("a", 1, 1), ("b", 2, 2), ("c", 3, 3)])
    inst = spark.createDataFrame([("a",), ("c",)], "entity STRING")
    assert sorted(r["entity"] for r in metrics.restrict(df, inst, "entity").collect()) == ["a", "c"]
    top = metrics.latest(df, "ts", ["ts", "entity"], 2).collect()
    assert [r["entity"] for r in top] == ["c", "b"]


def brute_sustained(points, period, threshold, m, n):
    sums = defaultdict(list)
    for e, s, v in points:
        sums[(e, s // period)].append(v)
    avgs = {k: sum(v) / len(v) for k, v in sums.items()}
    out = set()
    for (e, b), _ in avgs.items():
        breaches = sum(1 for j in range(b - n + 1, b + 1) if (e, j) in avgs and avgs[(e, j)] >= threshold)
        if breaches >= m:
            out.add((e, b * period, breaches))
    return out


@pytest.mark.parametrize("m,n", [(5, 5), (3, 5), (1, 1)])
def test_sustained_alarm_against_brute_force(spark, m, n):
    import random
    rnd = random.Random(7)
    points = [(rnd.choice("xy"), rnd.randrange(0, 60 * 40), rnd.uniform(60, 100)) for _ in range(600)]
    df = series(spark, points)
    got = {(r["entity"], int((r["window_start"] - T0).total_seconds()), r["breaches"])
           for r in metrics.sustained_alarm(df, "ts", "entity", "value", 60, 85.0, ">=", m, n).collect()}
    assert got == brute_sustained(points, 60, 85.0, m, n)


def test_threshold_alarm(spark):
    df = series(spark, [("a", 10, 70), ("a", 20, 60), ("a", 310, 90)])
    got = metrics.threshold_alarm(df, "ts", "entity", "value", 300, 75.0, "LessThanThreshold").collect()
    assert [(r["window_start"], r["value"]) for r in got] == [(T0, 65.0)]


def test_events_alarm_runs_on_testdata(spark):
    ev = spark.read.parquet(f"{TESTDATA}/sf0.001/events.parquet")
    out = metrics.sustained_alarm(ev, "ts", "event_type", "value", "1 hour", 40.0, ">=", 2, 3)
    assert out.count() >= 0 and out.columns == ["event_type", "window_start", "window_end", "breaches"]
