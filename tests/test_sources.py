import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shardwise.sources import csv as src
from shardwise.sources import meta
from shardwise.sources.frames import pandas_to_spark


def test_header_modes():
    assert src.header_flag("infer") is True
    assert src.header_flag(0) is True
    assert src.header_flag(True) is True
    assert src.header_flag(None) is False
    assert src.header_flag(False) is False
    with pytest.raises(ValueError):
        src.header_flag(1)
    with pytest.raises(ValueError):
        src.header_flag("yes")


def test_resolve_uri():
    assert src.resolve_uri("s3://bucket/a/*.csv") == "s3a://bucket/a/*.csv"
    assert src.resolve_uri("file:///tmp/x.csv") == "file:///tmp/x.csv"
    assert src.resolve_uri("/tmp/x.csv") == "/tmp/x.csv"
    assert src.resolve_uri("hdfs://nn/x") == "hdfs://nn/x"
    with pytest.raises(NotImplementedError):
        src.resolve_uri("https://example.org/train.csv")


def test_storage_option_coercion():
    assert src.coerce_storage_options(None) == {"anon": True}
    assert src.coerce_storage_options({"anon": "False"})["anon"] is False
    assert src.coerce_storage_options({"anon": "true"})["anon"] is True
    assert src.coerce_storage_options({"anon": 0})["anon"] is False


def test_storage_options_set_bucket_credentials(spark):
    src.apply_storage_options(spark, "s3://my-bucket/data/*.csv", {"anon": "true"})
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert conf.get("fs.s3a.bucket.my-bucket.aws.credentials.provider") == src.ANONYMOUS_PROVIDER


def test_read_objects_positional(spark, gauge_csv):
    with_header, headerless = gauge_csv
    a = src.read_objects(spark, with_header, header="infer")
    b = src.read_objects(spark, headerless, header=None)
    assert a.columns == [str(i) for i in range(6)] == b.columns
    assert a.count() == b.count() == 8
    assert sorted(tuple(r) for r in a.collect()) == sorted(tuple(r) for r in b.collect())
    named = src.read_objects(spark, with_header, header=0, positional_names=False)
    assert named.columns[:2] == ["day", "level"]


def test_read_objects_no_match(spark, tmpdir_path):
    with pytest.raises(FileNotFoundError):
        src.read_objects(spark, f"{tmpdir_path}/missing/*.csv")


def test_meta_paths(spark, tmpdir_path):
    assert meta.parent_of("/data/x/*.csv") == "/data/x"
    assert meta.parent_of("/data/x/part-1.csv") == "/data/x"
    assert meta.find_meta(spark, f"{tmpdir_path}/*.csv", "stats") is None


def test_stats_round_trip(spark, tmpdir_path):
    wide = spark.createDataFrame([("count", 8.0, 1.0), ("mean", 2.5, 3.0), ("stddev", 1.0, 0.5),
                                  ("min", 0.0, 1.0), ("max", 5.0, 4.0)], "summary STRING, a DOUBLE, b DOUBLE")
    meta.write_stats(wide, tmpdir_path)
    path = meta.find_meta(spark, f"{tmpdir_path}/*.csv", "stats")
    back = meta.read_stats(spark, path)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in wide.collect())


def test_pandas_to_spark_keeps_index(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0]}, index=pd.Index(["mean", "stddev"], name="summary"))
    df = pandas_to_spark(spark, pdf)
    assert df.columns == ["summary", "a"]
    assert pandas_to_spark(spark, pdf, save_index=False).columns == ["a"]


def test_scale_conf():
    from shardwise.session import scale_conf

    conf = scale_conf(100 * 10**12)
    assert int(conf["spark.sql.shuffle.partitions"]) > 300_000
    assert int(conf["shardwise.rowindex.buckets"]) > 90_000
    small = scale_conf(10**6)
    assert small["spark.sql.shuffle.partitions"] == "200" and small["shardwise.rowindex.buckets"] == "64"


def test_storage_settings_map_or_refuse():
    s3 = src.storage_settings("s3://b/x", {"key": "k", "secret": "s", "token": "t",
                                           "client_kwargs": {"endpoint_url": "http://e", "region_name": "r"}})
    prefix = "fs.s3a.bucket.b."
    assert s3 == {prefix + "aws.credentials.provider": src.SESSION_PROVIDER, prefix + "access.key": "k",
                  prefix + "secret.key": "s", prefix + "session.token": "t", prefix + "endpoint": "http://e",
                  prefix + "endpoint.region": "r"}
    assert src.storage_settings("gs://b/x", {"token": "/k.json"})[src.GS_KEYFILE] == "/k.json"
    assert src.storage_settings("gs://b/x") == {"fs.gs.auth.type": "UNAUTHENTICATED"}
    for uri, options in (("s3://b/x", {"profile": "p"}), ("gs://b/x", {"key": "k"}), ("/x", {"key": "k"}),
                         ("s3://b/x", {"client_kwargs": {"verify": False}})):
        with pytest.raises(ValueError):
            src.storage_settings(uri, options)


def test_parent_of_brace_patterns():
    assert meta.parent_of("/data/x/{a,b}.csv") == "/data/x"


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_manifest_counts_the_written_parts(spark, tmpdir_path, fmt):
    target = os.path.join(tmpdir_path, "out")
    # Rows that differ between runs of a task, quoted line breaks, an empty partition in between.
    df = (spark.range(0, 90, 1, 3).where("id < 30 or id >= 60 and rand() < 0.5")
          .select(F.col("id"), F.concat(F.lit('a "b"\n'), F.col("id").cast("string"), F.lit(",c\\")).alias("t")))
    raw = meta.write_with_manifest(df, target, fmt=fmt)
    back = spark.read.options(header=True, multiLine=True).format(fmt).load(target)
    per_file = [r["count"] for r in back.groupBy(F.input_file_name().alias("f")).count().orderBy("f").collect()]
    assert [r["count"] for r in raw.orderBy("id").collect()] == per_file
    assert [r["id"] for r in raw.orderBy("id").collect()] == list(range(len(per_file)))
    meta.write_with_manifest(spark.range(7).select("id", F.lit("x").alias("t")), target, fmt=fmt, mode="append")
    raw = meta.read_raw(spark, f"{target}/.meta/shards")
    assert raw.agg(F.sum("count")).first()[0] == sum(per_file) + 7
    assert sorted(os.listdir(f"{target}/.meta")) == ["shards"]


def test_a_failed_write_leaves_no_manifest(spark, tmpdir_path, monkeypatch):
    target = os.path.join(tmpdir_path, "out")
    meta.write_with_manifest(spark.range(9), target)
    monkeypatch.setattr(meta, "write_manifest", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        meta.write_with_manifest(spark.range(5), target, mode="append")
    assert meta.find_meta(spark, f"{target}/part-*", "shards") is None


def test_nothing_written_gives_an_empty_manifest(spark, tmpdir_path):
    raw = meta.write_with_manifest(spark.range(0), os.path.join(tmpdir_path, "none"), header=False)
    assert raw.agg(F.sum("count")).first()[0] in (None, 0)
