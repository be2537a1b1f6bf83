import os

from pyspark.sql import functions as F

from shardwise.functions.rowindex import (with_csv_row_index, with_parquet_row_index,
                                          with_row_index)
from shardwise.operators import manifest as man

from .conftest import TESTDATA


def test_unique_numeric_key_matches_rank(spark):
    df = spark.read.parquet(f"{TESTDATA}/sf0.001/orders.parquet")
    idx, n = with_row_index(df, "o_orderkey", num_ranges=7, return_count=True)
    assert n == df.count()
    got = {r["o_orderkey"]: r["row_idx"] for r in idx.select("o_orderkey", "row_idx").collect()}
    expected = {k: i for i, k in enumerate(sorted(got))}
    assert got == expected


def test_string_key(spark):
    df = spark.createDataFrame([(f"k{i:03d}", i) for i in range(57)], "k STRING, v INT")
    idx = with_row_index(df, "k", num_ranges=5)
    got = sorted((r["row_idx"], r["k"]) for r in idx.collect())
    assert [k for _, k in got] == sorted(f"k{i:03d}" for i in range(57))
    assert [i for i, _ in got] == list(range(57))


def test_composite_key(spark):
    rows = [(a, b) for a in range(6) for b in range(5, 0, -1)]
    df = spark.createDataFrame(rows, "a INT, b INT")
    idx = with_row_index(df, ["a", "b"], num_ranges=4)
    got = [(r["a"], r["b"]) for r in idx.orderBy("row_idx").collect()]
    assert got == sorted(rows)


def test_non_unique_key_is_a_bijection_and_splits_a_hot_key(spark):
    # one key holds a third of the rows
    rows = [(0 if i % 3 == 0 else i, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k LONG, v LONG").repartition(4)
    idx = with_row_index(df, "k", num_ranges=8)
    out = idx.select("k", "row_idx").collect()
    assert sorted(r["row_idx"] for r in out) == list(range(300))
    ordered = [r["k"] for r in sorted(out, key=lambda r: r["row_idx"])]
    assert ordered == sorted(ordered)


def test_null_keys_come_first(spark):
    df = spark.createDataFrame([(3,), (None,), (1,), (2,)], "k INT")
    got = [r["k"] for r in with_row_index(df, "k", num_ranges=2).orderBy("row_idx").collect()]
    assert got == [None, 1, 2, 3]


def write_parts(d, parts, header=True):
    os.makedirs(d, exist_ok=True)
    for i, rows in enumerate(parts):
        with open(os.path.join(d, f"part-{i:05d}.csv"), "w") as f:
            if header:
                f.write("x,y\n")
            for r in rows:
                f.write(f"{r},{r * 10}\n")
    return d


def test_csv_physical_order_over_files(spark, tmpdir_path):
    d = write_parts(os.path.join(tmpdir_path, "c"), [[5, 6], [1, 2, 3], [], [9]])
    glob = f"{d}/*.csv"
    raw = man.count_objects(spark, glob, header=True)
    manifest = man.make_manifest(df=raw).join(man.list_objects(spark, glob).select("id", "uri"), "id")
    scan = spark.read.option("header", True).csv(glob)
    idx = with_csv_row_index(scan, manifest)
    got = [int(r["x"]) for r in idx.orderBy("row_idx").collect()]
    assert got == [5, 6, 1, 2, 3, 9]
    assert sorted(r["row_idx"] for r in idx.collect()) == list(range(6))


def test_csv_physical_order_with_small_splits(spark, tmpdir_path):
    d = write_parts(os.path.join(tmpdir_path, "s"), [list(range(0, 400)), list(range(1000, 1300))], header=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        scan = spark.read.csv(f"{d}/*.csv")
        idx = with_csv_row_index(scan)
        got = [int(r["_c0"]) for r in idx.orderBy("row_idx").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(range(0, 400)) + list(range(1000, 1300))


def test_parquet_physical_order(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "pq")
    spark.range(0, 50, 1, 3).withColumn("v", F.col("id") * 2).write.parquet(path)
    files = sorted(f"file:{path}/{f}" for f in os.listdir(path) if f.endswith(".parquet"))
    scan = spark.read.parquet(path)
    counts = {r["f"]: r["c"] for r in scan.groupBy(F.col("_metadata.file_path").alias("f")).count()
              .withColumnRenamed("count", "c").collect()}
    objs, start = [], 0
    for i, f in enumerate(files):
        objs.append((i, start, start + counts.get(f, 0), f))
        start += counts.get(f, 0)
    manifest = spark.createDataFrame(objs, "id INT, start_idx BIGINT, end_idx BIGINT, uri STRING")
    idx = with_parquet_row_index(scan, manifest)
    assert sorted(r["row_idx"] for r in idx.collect()) == list(range(50))


def test_explicit_tiebreak_column(spark):
    rows = [(i % 3, i) for i in range(40)]
    df = spark.createDataFrame(rows, "k INT, seq INT")
    got = [(r["k"], r["seq"]) for r in with_row_index(df, "k", tiebreak="seq", num_ranges=4)
           .orderBy("row_idx").collect()]
    assert got == sorted(rows)


def test_large_listing_goes_through_arrow(spark):
    from shardwise.session import literal_rows

    rows = [(i, f"file:/x/{i:06d}.csv", i % 7) for i in range(2500)]
    df = literal_rows(spark, rows, "id INT, uri STRING, size BIGINT")
    assert df.count() == 2500 and df.where("size = 0").count() == len([r for r in rows if r[2] == 0])
    assert dict(df.dtypes) == {"id": "int", "uri": "string", "size": "bigint"}


def places_per_range(spark, df, key, ranges):
    """Rows of each written range."""
    from shardwise.functions import rowindex as R

    kept = []
    real = R.written
    try:
        R.written = lambda d, name: kept.append(real(d, name)) or kept[-1]
        R.with_row_index(df, key, num_ranges=ranges)
    finally:
        R.written = real
    return [r["count"] for r in kept[0].groupBy("__part").count().collect()]


def test_hot_null_and_repeated_keys_spread_over_ranges(spark):
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k LONG, v LONG").repartition(4)
    assert max(places_per_range(spark, df, "k", 12)) < 1500  # 2,000 rows each have a null or a 5
    same = spark.range(0, 6000, 1, 4).select(F.lit(1).alias("k"))  # rows that are equal throughout
    assert max(places_per_range(spark, same, "k", 12)) < 1500


def test_configured_range_count_is_used(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"))
    spark.conf.set("shardwise.rowindex.buckets", "6")
    try:
        counts = places_per_range(spark, df, "k", None)
    finally:
        spark.conf.unset("shardwise.rowindex.buckets")
    assert len(counts) == 6 and sum(counts) == 1000


def test_infinite_and_nan_keys(spark):
    values = [float("inf"), 1.0, float("-inf"), None, float("nan"), 2.0] * 20
    df = spark.createDataFrame([(v,) for v in values], "k DOUBLE")
    got = [r["k"] for r in with_row_index(df, "k", num_ranges=7).orderBy("row_idx").collect()]
    assert got[:20] == [None] * 20 and got[20] == float("-inf") and got[80] == float("inf")
    assert all(v != v for v in got[100:])


def test_empty_input(spark):
    idx, n = with_row_index(spark.range(0).toDF("k"), "k", return_count=True)
    assert n == 0 and idx.count() == 0
