"""Session helpers: sensible defaults for large jobs, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults for every session built here. AQE re-plans joins and coalesces small
# shuffle partitions at runtime; skew-join splitting handles a hot key that holds
# a large share of rows. The UI stays off (no server, no port).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "shardwise", master: str | None = None,
                conf: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults applied."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only in a local session that has none (a test run) is a folder set here, the
    ``fallback`` or a temporary one; a cluster must name its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: name a folder on shared storage (HDFS, S3, ...) "
                "that every executor can reach")
        configured = fallback or tempfile.mkdtemp(prefix="shardwise-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written intermediate table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/shardwise-{name}-{uuid.uuid4().hex}"


def default_parallelism(spark: SparkSession) -> int:
    """Number of range partitions to use when the caller gives none."""
    value = spark.conf.get("spark.sql.shuffle.partitions", "200")
    try:
        return max(1, int(value))
    except ValueError:
        return max(1, spark.sparkContext.defaultParallelism)


LITERAL_ROWS_MAX = 1000


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str):
    """A small table from driver-side values, built on the JVM (no Python worker).

    ``schema`` is a DDL string such as ``"id INT, count BIGINT"``. Meant for
    bounded tables: a listing of objects, a handful of parameter rows.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(schema)
    names = [f.name for f in struct.fields]
    empty = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in struct.fields])
    if not rows:
        return empty
    if len(rows) > LITERAL_ROWS_MAX:
        # Larger tables go through Arrow batches handed to the JVM (still no Python worker).
        import pandas as pd

        frame = pd.DataFrame.from_records(rows, columns=names)
        return spark.createDataFrame(frame, schema=struct)
    items = F.array(*[
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, struct.fields)])
        for row in rows
    ])
    return spark.range(1).select(F.inline(items)).select(*names)


def scale_conf(input_bytes: int, target_partition_bytes: int = 256 << 20,
               max_split_bytes: int = 512 << 20) -> dict[str, str]:
    """Settings sized for an input of ``input_bytes`` (pass them to :func:`get_session`).

    Shuffle partitions are chosen so that a partition of the widest shuffle
    (about the input size) stays near ``target_partition_bytes``; AQE coalesces
    the smaller shuffles down to the same advisory size and splits skewed
    partitions of joins. File splits stay at ``max_split_bytes`` so a scan task
    reads a bounded amount. ``shardwise.rowindex.buckets`` is the number of
    key ranges ``with_row_index`` sorts (about 1 GiB of rows each).
    """
    parts = max(200, -(-input_bytes // target_partition_bytes))
    buckets = max(64, min(1 << 20, -(-input_bytes // (1 << 30))))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(max_split_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "shardwise.rowindex.buckets": str(buckets),
    }
