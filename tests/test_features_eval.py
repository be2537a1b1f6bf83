import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardwise.functions.arrays import log_softmax, log_sum_exp
from shardwise.functions.rowindex import with_row_index
from shardwise.operators import evaluate, features

from .conftest import TESTDATA


def test_feature_vector_keeps_numeric_in_order(spark):
    df = spark.createDataFrame([("a", 1, 2.5, True)], "s STRING, i INT, d DOUBLE, b BOOLEAN")
    row = features.feature_vector(df).first()
    assert list(row["features"]) == [1.0, 2.5, 1.0]
    with pytest.raises(ValueError):
        features.feature_vector(df.select("s"))


def test_shard_matrices_in_pos_order(spark):
    df = spark.createDataFrame([(0, 0, 1, [3.0]), (0, 0, 0, [1.0]), (1, 0, 0, [7.0])],
                               "worker INT, step LONG, pos LONG, features ARRAY<DOUBLE>")
    got = {(r["worker"], r["step"]): [list(x) for x in r["matrix"]]
           for r in features.shard_matrices(df).collect()}
    assert got == {(0, 0): [[1.0], [3.0]], (1, 0): [[7.0]]}


def test_standardize_constants_and_fitted(spark):
    df = spark.createDataFrame([(0.1307,), (0.4388,)], "x DOUBLE")
    got = [r["x"] for r in features.standardize(df, ["x"]).collect()]
    assert got == pytest.approx([0.0, 1.0])
    arr = spark.createDataFrame([([0.1307, 0.4388],)], "a ARRAY<DOUBLE>")
    assert list(arr.select(features.standardize_array("a").alias("z")).first()["z"]) == pytest.approx([0.0, 1.0])
    params = features.fit_standardizer(spark.createDataFrame([(1.0,), (3.0,)], "x DOUBLE"), ["x"])
    assert params["x"] == pytest.approx((2.0, math.sqrt(2.0)))


def test_batches_last_one_short(spark):
    idx = with_row_index(spark.range(0, 130).withColumnRenamed("id", "k"), "k")
    summary = features.batch_summary(features.assign_batches(idx, 64)).orderBy("batch").collect()
    assert [r["n_rows"] for r in summary] == [64, 64, 2]
    with pytest.raises(ValueError):
        features.assign_batches(idx, 0)


def test_log_softmax_matches_numpy(spark):
    vals = [1000.0, 1001.0, -5.0]
    row = spark.createDataFrame([(vals,)], "x ARRAY<DOUBLE>").select(log_softmax("x").alias("l")).first()
    x = np.array(vals)
    expected = x - (x.max() + np.log(np.exp(x - x.max()).sum()))
    assert list(row["l"]) == pytest.approx(list(expected))


def test_log_sum_exp_of_odd_arrays(spark):
    inf, nan = float("inf"), float("nan")
    cases = [[], [0.5], [-inf, 0.5, -inf], [3.0, None, 1.0], [1.0, nan], [-1e308, 1e308], [2.0, 2.0, 1.0, 5.0, 5.0]]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i INT, x ARRAY<DOUBLE>").orderBy("i").select(
        log_sum_exp("x").alias("z"), log_softmax("x").alias("l")).collect()
    assert rows[0]["z"] is None and rows[0]["l"] == []
    assert rows[1]["z"] == pytest.approx(0.5) and rows[2]["z"] == pytest.approx(0.5)
    assert rows[2]["l"] == pytest.approx([-inf, 0.0, -inf])
    assert rows[3]["z"] is None and rows[3]["l"] == [None, None, None]
    assert math.isnan(rows[4]["z"]) and rows[5]["z"] == pytest.approx(1e308)
    assert rows[6]["z"] == pytest.approx(math.log(2 * math.exp(5) + 2 * math.exp(2) + math.e))


def test_loss_is_linear_in_the_length(spark):
    def seconds(dims):
        scores = F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i: F.sin(i * (F.col("id") % 97 + 1)))
        df = spark.range(4000).select(scores.alias("x"), (F.col("id") % dims).alias("y")).cache()
        df.count()
        best = math.inf
        for _ in range(3):
            start = time.perf_counter()
            total = evaluate.row_losses(df, "x", "y").agg(F.sum("loss")).first()[0]
            best = min(best, time.perf_counter() - start)
        assert total > 0
        df.unpersist()
        return best

    seconds(8)
    assert seconds(2048) < 20 * seconds(256) + 1


def test_epoch_loss_mean_of_batch_means(spark):
    emb = spark.read.parquet(f"{TESTDATA}/sf0.001/embeddings.parquet")
    idx = with_row_index(emb, "vec_id")
    scored = evaluate.row_losses(features.assign_batches(idx, 64), "embedding", "label")
    batches = evaluate.batch_losses(scored)
    res = evaluate.epoch_loss(batches).first()
    pdf = emb.orderBy("vec_id").toPandas()
    logits = np.stack([np.asarray(v, dtype=np.float64) for v in pdf.embedding])
    m = logits.max(axis=1, keepdims=True)
    logp = logits - (m + np.log(np.exp(logits - m).sum(axis=1, keepdims=True)))
    loss = -logp[np.arange(len(pdf)), pdf.label.to_numpy()]
    means = [loss[i:i + 64].mean() for i in range(0, len(loss), 64)]
    assert res["mean_batch_loss"] == pytest.approx(np.mean(means))
    assert res["mean_row_loss"] == pytest.approx(loss.mean())
    assert res["n_rows"] == len(pdf) and res["n_batches"] == len(means)
    assert batches.where(F.col("n_rows") > 64).count() == 0


def test_split_batches_each_with_its_size(spark):
    rows = [("train", i) for i in range(150)] + [("test", i) for i in range(30)] + [("validation", i) for i in range(5)]
    df = spark.createDataFrame(rows, "split STRING, k INT")
    out = features.assign_split_batches(df, "split", "k", {"train": 64, "test": 16, "validation": 1000})
    sizes = {}
    for r in out.groupBy("split", "batch").count().collect():
        sizes.setdefault(r["split"], []).append((r["batch"], r["count"]))
    assert sorted(sizes["train"]) == [(0, 64), (1, 64), (2, 22)]
    assert sorted(sizes["test"]) == [(0, 16), (1, 14)]
    assert sorted(sizes["validation"]) == [(0, 5)]
    first = out.where("split = 'test' and batch = 1 and batch_pos = 0").first()
    assert first["k"] == 16


def test_round_half_away(spark):
    from shardwise.functions.columns import round_half_away

    vals = [1.23456749, -1.23456751, 2.5e-7, -2.5e-7, 0.0, 123456789.1234567, None, float("inf")]
    df = spark.createDataFrame([(v,) for v in vals], "x DOUBLE")
    got = [r["r"] for r in df.select(round_half_away("x", 6).alias("r")).collect()]
    assert got[0] == pytest.approx(1.234567) and got[1] == pytest.approx(-1.234568)
    assert got[2] == 0.0 and got[3] == 0.0  # 0.25 units of the last place
    ties = spark.createDataFrame([(1.5,), (-2.5,), (0.5,)], "x DOUBLE")
    assert [r["r"] for r in ties.select(round_half_away("x", 0).alias("r")).collect()] == [2.0, -3.0, 1.0]
    assert got[4] == 0.0 and got[5] == pytest.approx(123456789.123457)
    assert got[6] is None and got[7] == float("inf")
