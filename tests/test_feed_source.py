"""The feed as a stream source: restarts, wrap-around, row ranges."""

import os

import pytest
from pyspark.sql import functions as F

from shardwise.streaming import source


def table(spark, folder, n, parts=5):
    path = os.path.join(folder, "indexed rows")
    (spark.range(n).select((F.col("id") * 7).alias("k"), F.timestamp_seconds(F.col("id")).alias("at"),
                           F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("v"),
                           F.col("id").alias("row_idx"))
     .repartitionByRange(parts, "row_idx").sortWithinPartitions("row_idx").write.parquet(path))
    return path


def run(spark, folder, path, until, **options):
    stream = source.shard_feed(spark, path, until=until, **options)
    out = os.path.join(folder, "fed")
    query = (stream.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", os.path.join(folder, "ck")).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(out)


@pytest.mark.parametrize("worker", [None, 1])
def test_restarts_repeat_no_row_and_wrap(spark, tmpdir_path, worker):
    n, s, r = 53, 6, 2
    path = table(spark, tmpdir_path, n)
    options = dict(row_count=n, shard_size=s, replicas=r, worker=worker, rows_per_partition=10,
                   index_path=source.object_index(spark, path))
    for until in (3, 3, 8):
        got = run(spark, tmpdir_path, path, until, **options).collect()
    want = []
    for step in range(8):
        for w in range(r) if worker is None else [worker]:
            for pos in range(s):
                i = ((step * r + w) * s + pos) % n
                want.append((w, step, pos, i * 7, None if i % 3 == 0 else str(i), i, i))
    assert sorted((x["worker"], x["step"], x["pos"], x["k"], x["v"] or "", x["row_idx"], int(x["at"].timestamp()))
                  for x in got) == sorted((*w[:4], w[4] or "", *w[5:]) for w in want)


def test_ranges_end_with_a_pass_and_at_the_limit():
    assert list(source.position_ranges(0, 3, 4, 2, 10)) == [(0, 10), (10, 20), (20, 24)]
    assert list(source.position_ranges(0, 2, 4, 2, 10, worker=1)) == [(4, 8), (12, 16)]
    assert list(source.position_ranges(0, 1, 25, 1, 10, limit=7)) == [
        (0, 7), (7, 10), (10, 17), (17, 20), (20, 25)]
    assert list(source.position_ranges(0, 5, 4, 2, 0)) == []


def test_a_partition_names_only_the_objects_of_its_rows(spark, tmpdir_path):
    path = table(spark, tmpdir_path, 1000, parts=10)
    index = source.object_index(spark, path)
    reader = source.ShardFeedReader(spark.read.parquet(path).schema, {
        "shard_size": "50", "replicas": "1", "row_count": "1000", "index": index, "until": "4"})
    assert reader.latestOffset() == {"step": 4}
    (part,) = reader.partitions({"step": 3}, {"step": 4})
    ((p, q, uris),) = part.ranges
    assert (p, q) == (150, 200) and 1 <= len(uris) <= 3


def test_a_feed_needs_an_end_or_a_clock(spark, tmpdir_path):
    with pytest.raises(ValueError, match="until"):
        source.shard_feed(spark, "nowhere", 10, 2)
    reader = source.ShardFeedReader(None, {"shard_size": "5", "replicas": "1", "row_count": "10",
                                           "steps_per_second": "2", "start_time": "0", "until": "1000"})
    assert reader.latestOffset() == {"step": 1000}
