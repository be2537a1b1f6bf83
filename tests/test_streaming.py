import os
import tempfile
import time
import uuid

from pyspark.sql import functions as F

from shardwise.functions.rowindex import with_row_index
from shardwise.operators import metrics, shards
from shardwise.streaming import feed
from shardwise.streaming import metrics as smetrics

from .conftest import TESTDATA


def indexed_table(spark, tmpdir_path, n=10):
    df = spark.range(n).select((F.col("id") * 7).alias("k"), F.col("id").alias("v"))
    idx, count = with_row_index(df, "k", return_count=True)
    path = feed.materialize(idx, os.path.join(tmpdir_path, "indexed"))
    return path, count


def test_shard_stream_cycles_like_the_batch_plan(spark, tmpdir_path):
    path, n = indexed_table(spark, tmpdir_path)
    table = spark.read.parquet(path)
    stream = feed.shard_stream(spark, table, n, shard_size=4, replicas=2, worker=0, rows_per_batch=1)
    name = f"feed_{uuid.uuid4().hex[:8]}"
    q = (stream.writeStream.format("memory").queryName(name)
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).start())
    deadline = time.time() + 120
    try:
        # the source never runs dry: poll until five steps have arrived
        while time.time() < deadline:
            if spark.table(name).select("step").distinct().count() >= 5:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    got = spark.table(name).where("step < 5").select("step", "pos", "row_idx").collect()
    by_step = {}
    for r in got:
        by_step.setdefault(r["step"], {})[r["pos"]] = r["row_idx"]
    # worker 0 of 2, s=4, N=10: [0-3], [8,9,0,1], [6-9], [4-7], [2-5]
    assert [[by_step[k][p] for p in range(4)] for k in range(5)] == [
        [0, 1, 2, 3], [8, 9, 0, 1], [6, 7, 8, 9], [4, 5, 6, 7], [2, 3, 4, 5]]


def test_foreach_batch_feed_restarts_from_checkpoint(spark, tmpdir_path):
    path, n = indexed_table(spark, tmpdir_path)
    out = os.path.join(tmpdir_path, "out")
    ck = os.path.join(tmpdir_path, "feed-ck")

    def run_batches(k):
        q = feed.start_shard_feed(spark, path, n, 3, out, ck, replicas=1, steps_per_batch=2,
                                  trigger={"availableNow": True})
        q.awaitTermination(120)
        q.stop()

    run_batches(1)
    first = sorted(os.listdir(out))
    run_batches(1)
    second = sorted(os.listdir(out))
    assert first and len(second) > len(first)
    written = spark.read.parquet(out)
    steps = sorted({r["step"] for r in written.select("step").collect()})
    assert steps == list(range(len(steps)))
    expected = shards.assign_shards(spark.read.parquet(path), n, 3, 1, len(steps))
    key = ["step", "pos", "row_idx"]
    assert sorted(tuple(r) for r in written.select(*key).collect()) == sorted(
        tuple(r) for r in expected.select(*key).collect())


def closed_source(ev, folder):
    """The events as stream files, and one event a month later that closes all their windows."""
    ev.write.mode("overwrite").parquet(os.path.join(folder, "e", "a"))
    last = ev.agg(F.max("ts").alias("ts")).first()["ts"]
    late = ev.where("event_type = 'view'").limit(1).withColumn("ts", (F.lit(last) + F.expr("INTERVAL 30 DAYS")).cast(ev.schema["ts"].dataType))
    late.write.mode("overwrite").parquet(os.path.join(folder, "e", "b"))
    return last, (ev.sparkSession.readStream.schema(ev.schema).option("recursiveFileLookup", "true")
                  .parquet(os.path.join(folder, "e")))


def drained(spark, df, folder, last):
    """Rows of the stream's windows that start no later than the last real event."""
    name = f"s_{uuid.uuid4().hex[:8]}"
    q = (df.writeStream.outputMode("append").format("memory").queryName(name)
         .option("checkpointLocation", tempfile.mkdtemp(prefix="ck-", dir=folder))
         .trigger(availableNow=True).start())
    q.awaitTermination(240)
    return [r for r in spark.table(name).collect() if r["window_start"].replace(tzinfo=None) <= last]


def test_stream_windows_equal_batch(spark, tmpdir_path):
    ev = spark.read.parquet(f"{TESTDATA}/sf0.001/events.parquet")
    last, stream = closed_source(ev, tmpdir_path)
    w = smetrics.stream_window_stat(stream, "ts", "user_id", "value", 3600, "avg", watermark="1 hour")
    streamed = sorted((r["user_id"], r["window_start"].replace(tzinfo=None), round(r["value"], 9))
                      for r in drained(spark, w, tmpdir_path, last))
    batch = sorted((r["user_id"], r["window_start"], round(r["value"], 9))
                   for r in metrics.window_stat(ev, "ts", "user_id", "value", 3600).collect())
    assert streamed == batch


def test_stream_sustained_alarm_equals_batch(spark, tmpdir_path):
    ev = spark.read.parquet(f"{TESTDATA}/sf0.01/events.parquet")
    last, stream = closed_source(ev, tmpdir_path)
    a = smetrics.stream_sustained_alarm(stream, "ts", "event_type", "value", "1 hour", 45.0, ">=",
                                        5, 5, watermark="1 hour")
    streamed = sorted((r["event_type"], r["window_start"].replace(tzinfo=None), r["breaches"])
                      for r in drained(spark, a, tmpdir_path, last))
    batch = sorted((r["event_type"], r["window_start"], r["breaches"]) for r in
                   metrics.sustained_alarm(ev, "ts", "event_type", "value", "1 hour", 45.0, ">=", 5, 5).collect())
    assert streamed == batch


def test_dataset_stream_matches_batch_shards(spark, tmpdir_path, station_csv):
    from shardwise.plans.dataset import ShardedDataset

    ds = ShardedDataset(spark, station_csv, header=None, worker=1, replicas=2, shard_size=300)
    stream = ds.stream(table_path=os.path.join(tmpdir_path, "tbl"))
    name = f"ds_{uuid.uuid4().hex[:8]}"
    q = (stream.writeStream.format("memory").queryName(name)
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck4")).start())
    deadline = time.time() + 120
    try:
        while time.time() < deadline:
            if spark.table(name).select("step").distinct().count() >= 3:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    got = sorted((r["step"], r["pos"], r["row_idx"]) for r in
                 spark.table(name).where("step < 3").select("step", "pos", "row_idx").collect())
    want = sorted((r["step"], r["pos"], r["row_idx"]) for r in
                  ds.shards(max_shards=3).select("step", "pos", "row_idx").collect())
    assert got == want


def test_stream_threshold_alarm_equals_batch(spark, tmpdir_path):
    ev = spark.read.parquet(f"{TESTDATA}/sf0.001/events.parquet")
    last, stream = closed_source(ev, tmpdir_path)
    a = smetrics.stream_threshold_alarm(stream, "ts", "event_type", "value", "1 hour", 35.0, "<",
                                        watermark="1 hour")
    streamed = sorted((r["event_type"], r["window_start"].replace(tzinfo=None))
                      for r in drained(spark, a, tmpdir_path, last))
    batch = sorted((r["event_type"], r["window_start"]) for r in
                   metrics.threshold_alarm(ev, "ts", "event_type", "value", "1 hour", 35.0, "<").collect())
    assert streamed == batch


def test_stream_pivot_equals_batch(spark, tmpdir_path):
    ev = spark.read.parquet(f"{TESTDATA}/sf0.001/events.parquet")
    last, stream = closed_source(ev, tmpdir_path)
    kinds = ["view", "click"]
    p = smetrics.stream_pivot_metrics(stream, "ts", "event_type", "event_type", "value", kinds, "1 hour",
                                      watermark="1 hour")
    streamed = sorted((r["event_type"], r["window_start"].replace(tzinfo=None), str(r["view"]), str(r["click"]))
                      for r in drained(spark, p, tmpdir_path, last))
    batch = sorted((r["event_type"], r["window_start"], str(r["view"]), str(r["click"])) for r in
                   metrics.pivot_metrics(ev, "ts", "event_type", "event_type", "value", kinds, "1 hour").collect())
    assert streamed == batch


def test_arrived_slices_count_late_rows_and_go_on_after_restarts(spark, tmpdir_path):
    folder, out, ck = (os.path.join(tmpdir_path, n) for n in ("slices", "emitted", "slices-ck"))
    schema = "ts TIMESTAMP, k STRING, value DOUBLE"

    def at(minute, value, k="a"):
        return (f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00", k, value)

    # The second slice has a row 15 minutes late (within the watermark of 20) and one 55 minutes late (beyond).
    slices = [[at(0, 1.0), at(10, 2.0), at(60, 4.0)], [at(45, 8.0), at(70, 16.0), at(5, 512.0)],
              [at(130, 32.0, None), at(600, 0.0)]]
    for rows in slices:
        (spark.createDataFrame(rows, "ts STRING, k STRING, value DOUBLE")
         .withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(folder))
        for _ in range(2):  # the second run finds nothing new
            smetrics.run_arrived(spark, folder, schema, lambda s: smetrics.stream_window_stat(
                s, "ts", "k", "value", 600, "sum", "20 minutes"), out, ck)
    got = {(r["window_start"].strftime("%H:%M"), r["k"]): r["value"] for r in spark.read.parquet(out).collect()}
    assert got == {("00:00", "a"): 1.0, ("00:10", "a"): 2.0, ("00:40", "a"): 8.0, ("01:00", "a"): 4.0,
                   ("01:10", "a"): 16.0, ("02:10", None): 32.0}
    assert spark.read.parquet(out).count() == len(got)
