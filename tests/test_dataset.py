"""Datasets over local CSV objects, with assertions on content."""

import math
import os

import pytest

from shardwise.operators import manifest as man
from shardwise.plans.dataset import ShardedDataset
from shardwise.sources import meta

from .conftest import GAUGE_ROWS


def gauge_values():
    return [[int(v) for v in line.split(",")] for line in GAUGE_ROWS]


def shard_rows(ds, step, worker=None):
    df = ds.shard(step, worker).drop("worker", "step", "pos", "row_idx")
    return [[None if v is None else v for v in r] for r in df.collect()]


def test_local_headerless(spark, gauge_csv):
    _, headerless = gauge_csv
    ds = ShardedDataset(spark, f"file://{headerless}", header=None, stats_glob=False)
    assert (ds.obj_count, ds.row_count) == (1, 8)
    assert shard_rows(ds, 0) == gauge_values()[:1]


def test_local_with_header(spark, gauge_csv):
    with_header, _ = gauge_csv
    ds = ShardedDataset(spark, f"file://{with_header}")
    assert ds.row_count == 8
    assert ds.table().columns == [str(i) for i in range(6)] + ["row_idx"]


def test_header_shard_size_2_max_shards_4(spark, gauge_csv):
    with_header, _ = gauge_csv
    ds = ShardedDataset(spark, f"file://{with_header}", shard_size=2, max_shards=4)
    feed = ds.shards().orderBy("step", "pos").collect()
    assert len(feed) == 8
    values = gauge_values()
    got = [[r[str(i)] for i in range(6)] for r in feed]
    assert got == values  # four shards of two rows walk through the file once
    assert ds.shards().groupBy("step").count().count() == 4


def test_two_fresh_reads_give_the_same_first_shard(spark, gauge_csv):
    with_header, _ = gauge_csv
    ds = ShardedDataset(spark, with_header, shard_size=4)
    assert len(shard_rows(ds, 0)) == 4
    assert shard_rows(ds, 0) == shard_rows(ds, 0)


def test_station_first_two_rows_numeric_golden(spark, station_csv):
    ds = ShardedDataset(spark, station_csv, header=None, shard_size=2, max_shards=1, stats_glob=False)
    feats = ds.features().orderBy("pos").collect()
    got = [list(r["features"]) for r in feats]
    # numeric columns only: date, value, three mostly empty columns
    assert len(got) == 2
    assert got[0][:2] == [5000.0, -29.0] and got[1][:2] == [5000.0, 2.0]
    assert all(v is None or math.isnan(v) for row in got for v in row[2:])


def test_station_365_by_2(spark, station_csv):
    ds = ShardedDataset(spark, station_csv, header=None, shard_size=365, max_shards=2)
    sizes = {r["step"]: r["count"] for r in ds.shards().groupBy("step").count().collect()}
    assert sizes == {0: 365, 1: 365}


def test_several_workers_partition_the_positions(spark, station_csv):
    per_worker = []
    for w in range(3):
        ds = ShardedDataset(spark, station_csv, header=None, worker=w, replicas=3, shard_size=50,
                            max_shards=2)
        per_worker.append(sorted(r["row_idx"] for r in ds.shards().collect()))
    assert sorted(sum(per_worker, [])) == list(range(300))


def test_parts_with_empty_and_header_only_objects(spark, parts_dir):
    ds = ShardedDataset(spark, f"{parts_dir}/*.csv", header="infer", shard_size=4, max_shards=2)
    assert (ds.obj_count, ds.row_count) == (3, 5)
    assert [tuple(r) for r in ds.manifest.orderBy("id").select("id", "start_idx", "end_idx").collect()] == [
        (1, 0, 2), (2, 2, 2), (3, 2, 5)]
    feed = ds.shards().orderBy("step", "pos").collect()
    # 8 positions over 5 rows: 1,2,3,4,5 then wrap to 1,2,3
    assert [int(r["0"]) for r in feed] == [1, 2, 3, 4, 5, 1, 2, 3]


def test_meta_manifest_is_used(spark, parts_dir):
    glob = f"{parts_dir}/*.csv"
    meta.write_manifest(man.count_objects(spark, glob, header=True), parts_dir)
    ds = ShardedDataset(spark, glob, header=True, shard_size=2, max_shards=1)
    assert ds.row_count == 5
    with pytest.raises(ValueError):
        ShardedDataset(spark, glob, index_shards="yes")


def test_read_spec_on_files(spark, parts_dir):
    ds = ShardedDataset(spark, f"{parts_dir}/*.csv", header=True)
    spec = ds.read_spec(1, 4).orderBy("seq").collect()
    assert [(os.path.basename(r["uri"]), r["skiprows"], r["numrows"]) for r in spec] == [
        ("part-00001.csv", 1, 1), ("part-00002.csv", 0, 0), ("part-00003.csv", 0, 2)]
    assert [int(r["0"]) for r in ds.slice(4, 1).orderBy("seq").collect()] == [5, 1]


def test_argument_checks(spark, gauge_csv):
    with_header, _ = gauge_csv
    with pytest.raises(ValueError):
        ShardedDataset(spark, "")
    with pytest.raises(ValueError):
        ShardedDataset(spark, with_header, worker=2, replicas=2, shard_size=1)
    with pytest.raises(ValueError):
        ShardedDataset(spark, with_header, header="yes")
    with pytest.raises(ValueError):
        ShardedDataset(spark, with_header).shards()  # unbounded: needs the stream
    with pytest.raises(FileNotFoundError):
        ShardedDataset(spark, with_header + ".missing")


def test_text_columns_refused_for_features(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "t.csv")
    with open(path, "w") as f:
        f.write("a,b\nx,y\n")
    ds = ShardedDataset(spark, path, header=None, shard_size=1, max_shards=1)
    with pytest.raises(ValueError):
        ds.features()


def test_write_with_manifest_round_trip(spark, tmpdir_path):
    from pyspark.sql import functions as F

    target = os.path.join(tmpdir_path, "written")
    df = spark.range(0, 97, 1, 5).select(F.col("id").alias("x"), (F.col("id") * 2).alias("y"))
    raw = meta.write_with_manifest(df, target)
    assert sorted(r["count"] for r in raw.collect()) and sum(r["count"] for r in raw.collect()) == 97
    ds = ShardedDataset(spark, f"{target}/*.csv", header=True, shard_size=10, max_shards=10)
    assert ds.row_count == 97
    got = [int(r["0"]) for r in ds.shards().orderBy("step", "pos").collect()]
    assert got == list(range(97)) + list(range(3))


def test_quoted_newline_counts_logical_rows(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "q.csv")
    with open(path, "w") as f:
        f.write('a,b\n1,"x\ny"\n2,z\n3,"p\nq\nr"\n')
    ds = ShardedDataset(spark, path, header=True, multiline=True, shard_size=3, max_shards=2)
    assert ds.row_count == 3
    rows = ds.shards().where("step = 0").orderBy("pos").collect()
    assert [int(r["0"]) for r in rows] == [1, 2, 3]
    assert rows[0]["1"] == "x\ny"


def test_materialized_table_gives_the_same_shards(spark, station_csv, tmpdir_path):
    ds = ShardedDataset(spark, station_csv, header=None, replicas=2, shard_size=64, max_shards=3)
    before = sorted(tuple(r) for r in ds.shards(worker=None).select("worker", "step", "pos", "row_idx", "3").collect())
    path = ds.materialize(os.path.join(tmpdir_path, "mat"))
    assert os.path.isdir(path.replace("file:", ""))
    after = sorted(tuple(r) for r in ds.shards(worker=None).select("worker", "step", "pos", "row_idx", "3").collect())
    assert before == after


def test_read_range_scans_only_the_overlapping_objects(spark, parts_dir):
    ds = ShardedDataset(spark, f"{parts_dir}/*.csv", header=True)
    pruned = ds.read_range(2, 0)  # from row 2 to the end (end < row_count, as in C2)
    pruned.collect()
    from pyspark.sql import functions as F

    path = F.col("_metadata.file_path")
    one = f"file:{parts_dir}/part-00003.csv"
    scan = ds.scan().where(path.between(one, one))
    scan.collect()
    metrics = scan._jdf.queryExecution().executedPlan().toString()
    assert "_metadata" in metrics or "file_path" in metrics  # a partition filter of the file list
    assert [int(r["0"]) for r in pruned.orderBy("seq").collect()] == [3, 4, 5]
    wrapped = ds.read_range(4, 1)
    assert [int(r["0"]) for r in wrapped.orderBy("seq").collect()] == [5, 1]
    full = sorted(tuple(r) for r in ds.slice(1, 4).collect())
    assert sorted(tuple(r) for r in ds.read_range(1, 4).collect()) == full


def test_read_shard_equals_planned_shard(spark, station_csv):
    ds = ShardedDataset(spark, station_csv, header=None, replicas=3, shard_size=350)
    for step, worker in [(0, 0), (0, 2), (1, 1)]:
        got = [(r["pos"], r["row_idx"]) for r in ds.read_shard(step, worker).collect()]
        want = [(r["pos"], r["row_idx"]) for r in ds.shard(step, worker).collect()]
        assert got == want and len(got) == 350


def station_values(path):
    with open(path) as f:
        return [int(line.split(",")[3]) for line in f if line.strip()]


def test_positions_hold_with_many_splits(spark, station_csv):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        ds = ShardedDataset(spark, station_csv, header=None, shard_size=10, max_shards=1)
        rows = ds.table().select("row_idx", "3").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ds._splits.count() > 5
    assert [r["3"] for r in sorted(rows, key=lambda r: r["row_idx"])] == station_values(station_csv)


@pytest.mark.parametrize("key, value", [("spark.sql.files.maxPartitionBytes", "2048"),
                                        ("spark.sql.files.maxPartitionNum", "1"),
                                        ("spark.sql.files.openCostInBytes", "1")])
def test_split_settings_may_change_between_counting_and_reading(spark, station_csv, key, value):
    ds = ShardedDataset(spark, station_csv, header=None, shard_size=10, max_shards=1)
    table = ds.table()
    spark.conf.set(key, value)
    try:
        rows = table.select("row_idx", "3").collect()
        again = ds.read_range(100, 400).select("row_idx", "3").collect()
    finally:
        spark.conf.unset(key)
    assert [r["3"] for r in sorted(rows, key=lambda r: r["row_idx"])] == station_values(station_csv)
    assert [r["3"] for r in sorted(again, key=lambda r: r["row_idx"])] == station_values(station_csv)[100:400]


@pytest.mark.parametrize("name", ["a b.csv", "per%20cent.csv", "aünï.csv", "a+b#c.csv"])
def test_object_names_that_need_escaping_keep_their_rows(spark, tmpdir_path, name):
    d = os.path.join(tmpdir_path, "odd")
    os.makedirs(d)
    for path, text in ((name, "x\n1\n2\n"), ("zz.csv", "x\n3\n")):
        with open(os.path.join(d, path), "w") as f:
            f.write(text)
    for stored in (False, True):
        if stored:
            meta.write_manifest(man.count_objects(spark, f"{d}/*.csv", header=True), d)
        ds = ShardedDataset(spark, f"{d}/*.csv", header=True)
        assert ds.row_count == 3
        assert [int(r["0"]) for r in ds.table().orderBy("row_idx").collect()] == [1, 2, 3]
        assert [int(r["0"]) for r in ds.read_range(1, 2).collect()] == [2]


def test_names_that_spark_would_skip_are_refused(spark, tmpdir_path):
    for name in ("_committed_1", "a.csv"):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write("x\n1\n")
    with pytest.raises(ValueError, match="_committed_1"):
        ShardedDataset(spark, f"{tmpdir_path}/*", header=True)


def test_a_manifest_that_counts_other_rows_is_an_error(spark, parts_dir):
    raw = spark.createDataFrame([(1, 2), (2, 1), (3, 3)], man.RAW_SCHEMA)
    meta.write_manifest(raw, parts_dir)
    ds = ShardedDataset(spark, f"{parts_dir}/*.csv", header=True)
    with pytest.raises(ValueError, match="part-00002"):
        ds.table()


def test_manifest_with_a_row_for_the_empty_first_object(spark, tmpdir_path):
    for name, text in (("p0.csv", ""), ("p1.csv", "x\n1\n2\n"), ("p2.csv", "x\n3\n")):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(text)
    meta.write_manifest(spark.createDataFrame([(0, 0), (1, 2), (2, 1)], man.RAW_SCHEMA), tmpdir_path)
    ds = ShardedDataset(spark, f"{tmpdir_path}/p*.csv", header=True)
    assert (ds.obj_count, ds.row_count) == (3, 3)
    assert [int(r["0"]) for r in ds.table().orderBy("row_idx").collect()] == [1, 2, 3]


def test_materialize_once_without_a_path(spark, station_csv):
    ds = ShardedDataset(spark, station_csv, header=None, shard_size=10, max_shards=1)
    first = ds.materialize()
    assert ds.materialize() == first
    assert ds.table().count() == 800
