"""The unbounded shard feed as Structured Streaming.

A ``rate-micro-batch`` source is the step counter: its ``value`` column counts
0, 1, 2, ... one step per row, ``rowsPerBatch`` steps per micro-batch, and the
offsets live in the query checkpoint, so a restarted query goes on where it
stopped (the last, uncommitted batch is replayed; sinks must be idempotent per
batch id).

Two forms:

* :func:`shard_stream` — a streaming DataFrame: steps are exploded into the
  positions of every worker, ``row_idx = ((step*r + w)*s + pos) mod N``, and a
  stream-static equi-join with the indexed table fetches the rows. Up to
  ``BROADCAST_BYTES`` of positions (``rows_per_batch * r * s``) are broadcast, so
  the table is not shuffled; beyond that both sides are. The table is scanned
  once per micro-batch (Spark applies no dynamic pruning inside micro-batches). Use it when such a scan is
  affordable, and :func:`start_shard_feed` for large tables.
* :func:`start_shard_feed` — a ``foreachBatch`` writer: each micro-batch's steps
  become a row-range filter on an index-sorted Parquet table (row groups are
  pruned by their min/max), so a step reads only the rows it needs; output is
  written per batch id with overwrite, which makes replays idempotent.

The indexed table is materialised once with :func:`materialize` into the
shared checkpoint folder (``spark.checkpoint.dir``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shards import assign_shards, validate_worker
from ..session import scratch_path


def materialize(indexed: DataFrame, path: str | None = None, row_idx: str = "row_idx") -> str:
    """Write the indexed table as Parquet sorted by ``row_idx`` inside each file; return the path."""
    target = path or scratch_path(indexed.sparkSession, "indexed")
    indexed.sortWithinPartitions(row_idx).write.mode("overwrite").parquet(target)
    return target


# Positions written out at a time, so that no row holds a whole shard's positions.
_CHUNK = 4096

# Bytes of positions (four numbers each) of a micro-batch that are broadcast.
BROADCAST_BYTES = 16 << 20


def step_positions(steps: DataFrame, shard_size: int, replicas: int, row_count: int,
                   worker: int | None = None, step_col: str = "value") -> DataFrame:
    """``step, worker, pos, row_idx`` for every step row of ``steps`` (stateless)."""
    s, r, n = int(shard_size), int(replicas), int(row_count)
    workers = F.array(F.lit(worker)) if worker is not None else F.sequence(F.lit(0), F.lit(r - 1))
    return (
        steps.select(F.col(step_col).cast("long").alias("step"))
        .withColumn("worker", F.explode(workers.cast("array<int>")))
        .withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit((s - 1) // _CHUNK)).cast("array<long>")))
        .withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(min(s, _CHUNK) - 1)).cast("array<long>")))
        .withColumn("pos", F.col("__c") * F.lit(_CHUNK) + F.col("pos")).where(F.col("pos") < F.lit(s)).drop("__c")
        .withColumn("row_idx", ((F.col("step") * F.lit(r) + F.col("worker")) * F.lit(s) + F.col("pos"))
                    % F.lit(n))
    )


def step_source(spark: SparkSession, rows_per_batch: int = 1, start_time: int = 0) -> DataFrame:
    """Streaming step counter: one row per step, ``rows_per_batch`` per micro-batch."""
    return (spark.readStream.format("rate-micro-batch")
            .option("rowsPerBatch", int(rows_per_batch))
            .option("startTimestamp", int(start_time))
            .load())


def shard_stream(spark: SparkSession, table: DataFrame, row_count: int, shard_size: int,
                 replicas: int = 1, worker: int | None = None, rows_per_batch: int = 1,
                 row_idx: str = "row_idx") -> DataFrame:
    """Endless feed: ``step, worker, pos`` + the table's columns, cycling over the data. [C9]"""
    validate_worker(0 if worker is None else worker, replicas, shard_size)
    positions = step_positions(step_source(spark, rows_per_batch), shard_size, replicas,
                               row_count, worker)
    data = table.withColumnRenamed(row_idx, "row_idx") if row_idx != "row_idx" else table
    workers = 1 if worker is not None else replicas
    small = int(rows_per_batch) * workers * int(shard_size) * 32 <= BROADCAST_BYTES
    return (F.broadcast(positions) if small else positions).join(data, "row_idx")


def start_shard_feed(spark: SparkSession, table_path: str, row_count: int, shard_size: int,
                     output_path: str, checkpoint_path: str | None = None, replicas: int = 1,
                     worker: int | None = None, steps_per_batch: int = 1,
                     trigger: dict | None = None, output_format: str = "parquet"):
    """Run the feed into ``output_path/batch=<id>``; returns the StreamingQuery. [C9]

    Every micro-batch covers the steps in its ``value`` range and reads only
    their rows from the index-sorted table at ``table_path``.
    """
    validate_worker(0 if worker is None else worker, replicas, shard_size)
    checkpoint = checkpoint_path or scratch_path(spark, "feed-checkpoint")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        bounds = batch.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
        if bounds["lo"] is None:
            return
        first, count = int(bounds["lo"]), int(bounds["hi"]) - int(bounds["lo"]) + 1
        table = batch.sparkSession.read.parquet(table_path)
        out = assign_shards(table, row_count, shard_size, replicas, count, worker, first_step=first)
        (out.write.mode("overwrite").format(output_format)
         .save(f"{output_path.rstrip('/')}/batch={batch_id}"))

    writer = (step_source(spark, steps_per_batch).writeStream
              .foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(**(trigger or {"processingTime": "0 seconds"}))
    return writer.start()
