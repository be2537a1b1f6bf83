"""A hot entity holding a third of all rows: results stay whole and exact, and the
aggregation is partial before the shuffle."""

import datetime as dt
import random

import pandas as pd
import pytest

from shardwise.operators import metrics

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(9000):
        entity = "hot" if i % 3 == 0 else f"e{rnd.randrange(200)}"
        rows.append((entity, T0 + dt.timedelta(seconds=rnd.randrange(0, 6 * 3600)), rnd.uniform(0, 100)))
    return spark.createDataFrame(rows, "entity STRING, ts TIMESTAMP_NTZ, value DOUBLE").repartition(6)


def test_window_stat_with_a_hot_entity_matches_pandas(spark, skewed):
    got = metrics.window_stat(skewed, "ts", "entity", "value", 600, "avg").toPandas()
    pdf = skewed.toPandas()
    pdf["window_start"] = pdf.ts.dt.floor("600s")
    want = pdf.groupby(["entity", "window_start"]).value.mean().reset_index()
    merged = got.merge(want, on=["entity", "window_start"], suffixes=("", "_want"))
    assert len(got) == len(want) == len(merged)
    assert (merged.value - merged.value_want).abs().max() < 1e-9
    assert got[got.entity == "hot"].shape[0] == pdf[pdf.entity == "hot"].window_start.nunique()


def test_sustained_alarm_with_a_hot_entity_is_whole(spark, skewed):
    got = metrics.sustained_alarm(skewed, "ts", "entity", "value", 600, 45.0, ">=", 2, 3).toPandas()
    pdf = skewed.toPandas()
    pdf["b"] = pdf.ts.dt.floor("600s")
    avg = pdf.groupby(["entity", "b"]).value.mean()
    want = set()
    for (e, b), _ in avg.items():
        prev = [b - pd.Timedelta(seconds=600 * k) for k in range(3)]
        n = sum(1 for p in prev if (e, p) in avg.index and avg[(e, p)] >= 45.0)
        if n >= 2:
            want.add((e, b, n))
    assert {(r.entity, r.window_start, r.breaches) for r in got.itertuples()} == want


def test_partial_aggregation_before_the_shuffle(spark, skewed):
    df = metrics.window_stat(skewed, "ts", "entity", "value", 600, "avg")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" in plan
