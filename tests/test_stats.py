import math

import numpy as np
import pandas as pd
import pytest

from shardwise.operators import stats

from .conftest import TESTDATA


def test_wide_summary_matches_pandas(spark, gauge_csv):
    with_header, _ = gauge_csv
    df = spark.read.options(header=True, inferSchema=True).csv(with_header)
    wide = stats.summary_wide(df).toPandas().set_index("summary")
    pdf = df.toPandas().astype(float)
    assert list(wide.index) == ["count", "mean", "stddev", "min", "max"]
    for c in pdf.columns:
        assert wide.loc["count", c] == len(pdf)
        assert wide.loc["mean", c] == pytest.approx(pdf[c].mean())
        assert wide.loc["stddev", c] == pytest.approx(pdf[c].std(ddof=1))
        assert wide.loc["min", c] == pdf[c].min() and wide.loc["max", c] == pdf[c].max()


def test_text_columns_are_left_out(spark):
    df = spark.createDataFrame([("a", 1, True), ("b", 3, False)], "s STRING, x INT, f BOOLEAN")
    long = stats.summarize(df)
    assert sorted(r["field"] for r in long.collect()) == ["x"]
    named = stats.summarize(df, ["x", "f"])
    assert sorted(r["field"] for r in named.collect()) == ["f", "x"]


def test_zscores_and_pvalues_against_numpy(spark):
    li = spark.read.parquet(f"{TESTDATA}/sf0.001/lineitem.parquet")
    cols = ["l_quantity", "l_discount"]
    population = stats.summary_wide(li, cols)
    sample = li.where("l_returnflag = 'R'")
    out = stats.sample_vs_population(sample, population, zscores_=True, pvalues_=True, columns=cols)
    res = out.toPandas().set_index("summary")
    assert list(res.index) == ["count", "mean", "stddev", "min", "max", "zscores", "pvalues"]
    full = li.select(*cols).toPandas()
    part = sample.select(*cols).toPandas()
    n = len(part)
    for c in cols:
        z = (part[c].mean() - full[c].mean()) / (full[c].std(ddof=1) / math.sqrt(n))
        assert res.loc["zscores", c] == pytest.approx(z)
        assert res.loc["pvalues", c] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_column_missing_from_population_gives_null(spark):
    sample = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0)], "a DOUBLE, b DOUBLE")
    population = spark.createDataFrame([("mean", 1.0), ("stddev", 2.0)], "summary STRING, a DOUBLE")
    res = stats.sample_vs_population(sample, population, zscores_=True, pvalues_=True).toPandas()
    res = res.set_index("summary")
    assert res.loc["zscores", "a"] == pytest.approx((2.0 - 1.0) / (2.0 / math.sqrt(2)))
    assert pd.isna(res.loc["zscores", "b"]) and pd.isna(res.loc["pvalues", "b"])


def test_largest_count_is_the_sample_size(spark):
    sample = spark.createDataFrame([(1.0, None), (3.0, 4.0), (5.0, None), (7.0, 8.0)], "a DOUBLE, b DOUBLE")
    population = spark.createDataFrame([("b", 5.0, 1.0)], "field STRING, mean DOUBLE, stddev DOUBLE")
    long = stats.zscores(stats.summarize(sample), population).where("field = 'b'").first()
    assert long["sample_size"] == 4
    assert long["zscore"] == pytest.approx((6.0 - 5.0) / (1.0 / 2.0))
    per_col = stats.zscores(stats.summarize(sample), population, per_column_n=True).where("field = 'b'").first()
    assert per_col["zscore"] == pytest.approx((6.0 - 5.0) / (1.0 / math.sqrt(2)))


def test_population_required_for_z(spark):
    df = spark.createDataFrame([(1.0,)], "a DOUBLE")
    with pytest.raises(ValueError):
        stats.sample_vs_population(df, None, zscores_=True)
    assert stats.sample_vs_population(df).count() == 5


def test_grouped_samples_in_one_pass(spark):
    li = spark.read.parquet(f"{TESTDATA}/sf0.001/lineitem.parquet")
    grouped = stats.summarize(li, ["l_quantity"], by="l_returnflag").toPandas()
    pdf = li.select("l_returnflag", "l_quantity").toPandas()
    for flag, g in pdf.groupby("l_returnflag"):
        row = grouped[grouped.l_returnflag == flag].iloc[0]
        assert row["mean"] == pytest.approx(g.l_quantity.mean())
        assert row["count"] == len(g)


def test_pvalue_tail_precision(spark):
    from shardwise.functions.normal import two_sided_pvalue

    df = spark.createDataFrame([(0.0,), (1.96,), (-3.0,), (12.0,), (None,)], "z DOUBLE")
    got = [r["p"] for r in df.select(two_sided_pvalue("z").alias("p")).collect()]
    assert got[0] == pytest.approx(1.0)
    assert got[1] == pytest.approx(0.04999579, rel=1e-6)
    assert got[2] == pytest.approx(0.0026997960632601, rel=1e-10)
    assert 0 < got[3] < 1e-30  # erfc keeps the tail; 1 - cdf would give 0
    assert got[4] is None
    assert np.isfinite(got[3])


def test_jvm_erfc_and_udf_agree_with_math(spark):
    from shardwise.functions.normal import erfc, two_sided_pvalue, two_sided_pvalue_udf

    xs = [-2.5, -0.3, 0.0, 0.7, 1.99, 2.0, 2.01, 4.5, 9.0, 27.0]
    df = spark.createDataFrame([(x,) for x in xs], "x DOUBLE")
    rows = df.select("x", erfc("x").alias("e"), two_sided_pvalue("x").alias("p"),
                     two_sided_pvalue_udf("x").alias("u")).collect()
    for r in rows:
        assert r["e"] == pytest.approx(math.erfc(r["x"]), rel=1e-12)
        assert r["p"] == pytest.approx(r["u"], rel=1e-12)


def test_zscores_by_group_single_pass_equals_two_passes(spark):
    li = spark.read.parquet(f"{TESTDATA}/sf0.001/lineitem.parquet")
    cols = ["l_quantity", "l_tax"]
    one = stats.zscores_by_group(li, "l_returnflag", cols)
    two = stats.zscores(stats.summarize(li, cols, by="l_returnflag"), stats.summarize(li, cols))
    key = lambda r: (r["l_returnflag"], r["field"])
    a = {key(r): r["zscore"] for r in one.collect()}
    b = {key(r): r["zscore"] for r in two.collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k])


def test_combine_groups_equals_direct_summary(spark):
    li = spark.read.parquet(f"{TESTDATA}/sf0.001/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    pooled = {r["field"]: r for r in stats.combine_groups(stats.summarize(li, cols, by="l_linestatus")).collect()}
    direct = {r["field"]: r for r in stats.summarize(li, cols).collect()}
    for c in cols:
        for k in ("count", "mean", "stddev", "min", "max"):
            assert pooled[c][k] == pytest.approx(direct[c][k], rel=1e-12)


def test_constant_population_column_gives_null_z(spark, gauge_csv):
    with_header, _ = gauge_csv
    df = spark.read.options(header=True, inferSchema=True).csv(with_header)
    population = stats.summary_wide(df)
    res = stats.sample_vs_population(df.limit(3), population, zscores_=True, pvalues_=True).toPandas()
    res = res.set_index("summary")
    # the gate never moves: stddev 0, so z and p are undefined (null), other columns are numbers
    assert pd.isna(res.loc["zscores", "gate"]) and pd.isna(res.loc["pvalues", "gate"])
    assert not pd.isna(res.loc["zscores", "level"])


def test_stored_stats_merge_with_added_rows_as_a_full_recomputation(spark, tmpdir_path):
    from shardwise.operators import stats
    from shardwise.sources import meta

    rows = [(i, float(i * 37 % 101) - 50 if i % 7 else None, 1e9 + i, None) for i in range(200)]
    schema = "a INT, b DOUBLE, c DOUBLE, d DOUBLE"
    whole = spark.createDataFrame(rows, schema)
    folder = f"file://{tmpdir_path}/moments"
    for lo, hi in ((0, 60), (60, 61), (61, 61), (61, 200)):
        got = meta.add_to_stats(spark.createDataFrame(rows[lo:hi], schema), folder)
    got = {r["summary"]: r.asDict() for r in got.collect()}
    want = {r["summary"]: r.asDict() for r in stats.summary_wide(whole).collect()}
    assert list(got) == list(want)
    for kind, row in want.items():
        for c in "abcd":
            if row[c] is None:
                assert got[kind][c] is None, (kind, c)
            else:
                assert abs(got[kind][c] - row[c]) <= 1e-9 * max(1.0, abs(row[c])), (kind, c)


def test_a_column_that_only_the_added_rows_have(spark):
    from shardwise.operators import stats

    stored = stats.summary_wide(spark.createDataFrame([(1.0,), (3.0,)], "a DOUBLE"))
    merged = {r["summary"]: r for r in stats.merge_summary(
        stored, spark.createDataFrame([(5.0, 2)], "a DOUBLE, e INT")).collect()}
    assert (merged["count"]["a"], merged["mean"]["a"], merged["stddev"]["a"], merged["max"]["a"]) == (3, 3, 2, 5)
    assert (merged["count"]["e"], merged["mean"]["e"], merged["stddev"]["e"]) == (1, 2, None)
