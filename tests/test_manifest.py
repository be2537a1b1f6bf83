import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardwise.operators import manifest as man
from shardwise.sources import meta


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_make_manifest_offsets(spark):
    raw = spark.createDataFrame([(2, 4), (0, 3), (1, 0)], man.RAW_SCHEMA)
    got = rows(man.make_manifest(df=raw), "id", "start_idx", "end_idx")
    assert got == [(0, 0, 3), (1, 3, 3), (2, 3, 7)]


def test_zero_row_duplicate_id(spark):
    raw = spark.createDataFrame([(0, 3), (1, 2)], man.RAW_SCHEMA).unionByName(
        spark.createDataFrame([(0, 0)], man.RAW_SCHEMA))
    got = man.make_manifest(df=raw).orderBy("start_idx", "end_idx").collect()
    assert [(r["id"], r["start_idx"], r["end_idx"]) for r in got] == [(0, 0, 0), (0, 0, 3), (1, 3, 5)]


def test_manifest_requires_id_and_count(spark):
    with pytest.raises(ValueError):
        man.make_manifest(df=spark.createDataFrame([(1, 2)], "id INT, n BIGINT"))
    with pytest.raises(ValueError):
        man.make_manifest()


def test_partition_counts(spark):
    df = spark.range(0, 100, 1, 4)
    counts = man.partition_counts(df).collect()
    assert sum(r["count"] for r in counts) == 100 and len(counts) == 4
    with_zero = man.partition_counts(df, include_empty_zero_id=True).collect()
    assert sorted((r["id"], r["count"]) for r in with_zero)[0] == (0, 0)
    assert len(with_zero) == 5


def test_count_objects_gap_and_header_only(spark, parts_dir):
    glob = f"{parts_dir}/*.csv"
    raw = man.count_objects(spark, glob, header="infer")
    # zero-byte part-00000 is skipped (id 0 missing), header-only part-00002 counts 0
    assert rows(raw, "id", "count") == [(1, 2), (2, 0), (3, 3)]
    headerless = man.count_objects(spark, glob, header=None)
    assert rows(headerless, "id", "count") == [(1, 3), (2, 1), (3, 4)]


def test_list_objects_fails_on_no_match(spark, tmpdir_path):
    with pytest.raises(FileNotFoundError):
        man.list_objects(spark, f"{tmpdir_path}/nothing-*.csv")


def test_attach_uris_positional(spark, parts_dir):
    listing = man.list_objects(spark, f"{parts_dir}/*.csv")
    raw = spark.createDataFrame([(7, 2), (8, 0), (9, 3)], man.RAW_SCHEMA)
    paired = man.attach_uris(man.make_manifest(df=raw), listing)
    got = rows(paired, "id", "uri")
    assert [g[0] for g in got] == [7, 8, 9]
    assert [os.path.basename(g[1]) for g in got] == ["part-00001.csv", "part-00002.csv", "part-00003.csv"]
    with pytest.raises(Exception, match="the manifest has 2 rows"):
        man.attach_uris(man.make_manifest(df=raw.where("id < 9")), listing).collect()
    with_empty = spark.createDataFrame([(0, 0), (7, 2), (8, 0), (9, 3)], man.RAW_SCHEMA)
    got = rows(man.attach_uris(man.make_manifest(df=with_empty), listing), "id", "uri")
    assert [os.path.basename(g[1]) for g in got] == [f"part-0000{i}.csv" for i in range(4)]


def test_manifest_totals(spark):
    raw = spark.createDataFrame([(0, 3), (1, 4)], man.RAW_SCHEMA)
    t = man.manifest_totals(man.make_manifest(df=raw)).first()
    assert (t["obj_count"], t["row_count"]) == (2, 7)


def test_build_manifest_both_ways(spark, parts_dir):
    glob = f"{parts_dir}/*.csv"
    counted = man.build_manifest(spark, glob, header=True)
    assert rows(counted, "id", "start_idx", "end_idx") == [(1, 0, 2), (2, 2, 2), (3, 2, 5)]
    # write the raw manifest beside the data, then read it back by convention
    raw = man.count_objects(spark, glob, header=True)
    meta.write_manifest(raw, parts_dir)
    found = meta.find_meta(spark, glob, "shards")
    assert found is not None and found.endswith(".meta/shards")
    read_back = man.build_manifest(spark, glob, header=True, shards_glob=found)
    assert rows(read_back, "id", "start_idx", "end_idx", "uri") == rows(counted, "id", "start_idx", "end_idx", "uri")


def test_read_raw_manifest_headerless(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "m.csv")
    with open(path, "w") as f:
        f.write("0;5\n1;7\n")
    raw = man.read_raw_manifest(spark, path, header=False, sep=";")
    assert rows(raw, "id", "count") == [(0, 5), (1, 7)]
    assert dict(raw.dtypes) == {"id": "int", "count": "bigint"}


def test_custom_hooks(spark, parts_dir):
    calls = []

    def my_counter(spark_, glob_, header=None, sep=","):
        calls.append(glob_)
        return spark_.createDataFrame([(1, 1), (2, 1), (3, 1)], man.RAW_SCHEMA)

    out = man.build_manifest(spark, f"{parts_dir}/*.csv", header=True, count_objects_fn=my_counter,
                             make_manifest_fn=lambda df=None, **kw: man.make_manifest(df=df).withColumn(
                                 "end_idx", F.col("end_idx")))
    assert calls and rows(out, "id", "end_idx") == [(1, 1), (2, 2), (3, 3)]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(counts=st.lists(st.integers(0, 50), min_size=1, max_size=12))
def test_property_intervals_are_disjoint_and_cover(spark, counts):
    raw = spark.createDataFrame(list(enumerate(counts)), man.RAW_SCHEMA)
    out = man.make_manifest(df=raw).orderBy("id").collect()
    assert out[0]["start_idx"] == 0 and out[-1]["end_idx"] == sum(counts)
    for a, b in zip(out, out[1:]):
        assert a["end_idx"] == b["start_idx"]
    assert [r["end_idx"] - r["start_idx"] for r in out] == counts
