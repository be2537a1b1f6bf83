"""The shard feed as a stream source of its own: offsets are steps, partitions are row ranges.

:func:`shard_feed` is an ordinary streaming DataFrame, as
:func:`shardwise.streaming.feed.shard_stream` is, but a micro-batch reads only
the rows of its steps. The positions of steps ``[a, b)`` are ranges of the row
index; every task gets ranges of at most ``rows_per_partition`` rows and reads
them from the index-sorted Parquet objects, whose row groups are skipped by
their least and greatest index. The planner knows the objects by an index of
one row each.

The last step comes from the query's checkpoint, so a restarted query repeats
nothing that was committed. ``until`` is how many steps may be handed out in
all; a feed that never ends is given ``steps_per_second`` and ``start_time``
(seconds since 1970) instead and hands out what is due by the clock.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.rowindex import object_uri
from ..operators.shards import validate_worker
from ..session import scratch_path

ROWS_PER_PARTITION = 250_000
FORMAT = "shardwise_feed"


def object_index(spark: SparkSession, table_path: str, row_idx: str = "row_idx") -> str:
    """Write ``uri, lo, hi`` (least and greatest index) of the table's objects; returns the path."""
    target = scratch_path(spark, "feed-index")
    scan = spark.read.parquet(table_path)
    (scan.groupBy(object_uri().alias("uri")).agg(F.min(row_idx).alias("lo"), F.max(row_idx).alias("hi"))
     .write.parquet(target))
    return target


def position_ranges(first: int, last: int, shard_size: int, replicas: int, row_count: int,
                    worker: int | None = None, limit: int = ROWS_PER_PARTITION) -> Iterator[tuple[int, int]]:
    """Ranges ``[p, q)`` of the endless position count for steps ``[first, last)``.

    All workers' positions of neighbouring steps follow each other; one worker's
    are a range per step. Ranges end where a pass over the data does, and after
    ``limit`` rows. The row of position ``p`` is ``p mod row_count``.
    """
    s, r, n = shard_size, replicas, row_count
    if n == 0:
        return
    if worker is None:
        whole = [(first * r * s, last * r * s)]
    else:
        whole = (((step * r + worker) * s, (step * r + worker + 1) * s) for step in range(first, last))
    for p, end in whole:
        while p < end:
            q = min(end, p + limit, (p // n + 1) * n)
            yield p, q
            p = q


class RowRanges(InputPartition):
    """``ranges``: ``(p, q, uris)``, read one after the other."""

    def __init__(self, ranges: list[tuple[int, int, list[str]]]):
        self.ranges = ranges


def _opened(uris: list[str]):
    """An Arrow dataset of Parquet objects or of one folder of them; all are in one file system."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    # Spark writes local URIs with one slash, or none of a scheme.
    full = [u if "://" in u else u.replace(":/", ":///", 1) if ":/" in u else f"file://{quote(u)}" for u in uris]
    places = [fs.FileSystem.from_uri(u) for u in full]
    paths = [path for _, path in places]
    return ds.dataset(paths if len(paths) > 1 else paths[0], filesystem=places[0][0], format="parquet")


class ShardFeedReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options):
        self.schema = schema
        self.options = dict(options)
        self.shard_size, self.replicas = int(options["shard_size"]), int(options["replicas"])
        self.row_count = int(options["row_count"])
        self.worker = None if options.get("worker", "") == "" else int(options["worker"])
        self.limit = int(options.get("rows_per_partition", ROWS_PER_PARTITION))
        self._objects: list[tuple[int, int, str]] | None = None

    def initialOffset(self) -> dict:
        return {"step": 0}

    def latestOffset(self) -> dict:
        due = []
        if "until" in self.options:
            due.append(int(self.options["until"]))
        if "steps_per_second" in self.options:
            passed = time.time() - float(self.options["start_time"])
            due.append(max(0, int(passed * float(self.options["steps_per_second"]))))
        return {"step": min(due)}

    def _overlapping(self, lo: int, hi: int) -> list[str]:
        if self._objects is None:
            index = _opened([self.options["index"]]).to_table().to_pydict()
            self._objects = sorted(zip(index["lo"], index["hi"], index["uri"]))
        return [uri for a, b, uri in self._objects if a < hi and b >= lo]

    def partitions(self, start: dict, end: dict) -> list[RowRanges]:
        out: list[RowRanges] = []
        held, rows = [], 0
        for p, q in position_ranges(start["step"], end["step"], self.shard_size, self.replicas, self.row_count,
                                    self.worker, self.limit):
            lo = p % self.row_count
            if held and rows + q - p > self.limit:
                out.append(RowRanges(held))
                held, rows = [], 0
            held.append((p, q, self._overlapping(lo, lo + q - p)))
            rows += q - p
        if held:
            out.append(RowRanges(held))
        return out

    def read(self, partition: RowRanges):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(self.schema)
        s, r, n = self.shard_size, self.replicas, self.row_count
        for p, q, uris in partition.ranges:
            lo = p % n
            where = (pc.field("row_idx") >= lo) & (pc.field("row_idx") < lo + q - p)
            seen = 0
            for batch in _opened(uris).to_batches(filter=where):
                if not batch.num_rows:
                    continue
                at = batch.column(batch.schema.get_field_index("row_idx")).to_numpy() + np.int64(p - lo)
                tags = {"worker": (at // s) % r, "step": (at // s) // r, "pos": at % s}
                columns = [pa.array(tags[f.name]).cast(f.type) if f.name in tags
                           else batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in target]
                seen += batch.num_rows
                yield pa.RecordBatch.from_arrays(columns, schema=target)
            if seen != q - p:
                raise ValueError(f"rows [{lo}, {lo + q - p}) of the table: {seen} found")


class ShardFeed(DataSource):
    """The data source; made known to a session by :func:`shard_feed`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.options["table_schema"]))

    def streamReader(self, schema: StructType) -> ShardFeedReader:
        return ShardFeedReader(schema, self.options)


def shard_feed(spark: SparkSession, table_path: str, row_count: int, shard_size: int, replicas: int = 1,
               worker: int | None = None, until: int | None = None, steps_per_second: float | None = None,
               start_time: float | None = None, index_path: str | None = None,
               rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """``worker, step, pos`` + the columns of the indexed table at ``table_path``, as a stream. [C9]

    ``worker=None`` feeds all workers. Pass the ``index_path`` of an earlier
    :func:`object_index` to spare the scan of the index column. Objects are read
    through Arrow's file systems (local, hdfs, s3, gs). An empty table feeds nothing.
    """
    validate_worker(0 if worker is None else worker, replicas, shard_size)
    if until is None and steps_per_second is None:
        raise ValueError("a feed needs until= (steps in all) or steps_per_second=")
    if steps_per_second is not None and start_time is None:
        raise ValueError("steps_per_second counts from start_time: pass it, the same at every start")
    data = spark.read.parquet(table_path).schema
    tags = [StructField("worker", IntegerType()), StructField("step", LongType()), StructField("pos", LongType())]
    clash = {t.name for t in tags} & set(data.names)
    if clash:
        raise ValueError(f"the table already has columns {sorted(clash)}")
    spark.dataSource.register(ShardFeed)
    options = {"table_schema": json.dumps(StructType(tags + list(data.fields)).jsonValue()),
               "index": index_path or object_index(spark, table_path), "row_count": row_count,
               "shard_size": shard_size, "replicas": replicas, "worker": "" if worker is None else worker,
               "rows_per_partition": rows_per_partition, "until": until,
               "steps_per_second": steps_per_second, "start_time": start_time}
    reader = spark.readStream.format(FORMAT)
    for key, value in options.items():
        if value is not None:
            reader = reader.option(key, str(value))
    return reader.load()
