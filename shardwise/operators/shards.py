"""Round-robin sharding of an indexed table.

Worker ``w`` of ``r`` reads, at step ``k``, the ``s`` global positions
``[(k*r + w)*s, (k*r + w + 1)*s)``; a position ``p`` addresses row
``p mod N``, so a shard that runs past the end wraps to the head, and a shard
larger than the data repeats rows. Instead of reading slices file by file, the
positions become column arithmetic on the indexed table:

    epoch e in 0..E-1, p = e*N + row_idx, keep p < r*M*s
    shard = p div s, worker = shard mod r, step = shard div r, pos = p mod s

No join and no shuffle: each input row is expanded to the (few) epochs that use
it. ``where worker = w`` gives one worker's feed.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_sizes(shard_size: int | None = None, batch_size: int | None = None) -> tuple[int, int]:
    """Settle ``(shard_size, batch_size)``: both given -> the smaller one for both,
    one given -> used for both, none -> error; only positive integers. [C10]"""
    def positive(v):
        return isinstance(v, int) and not isinstance(v, bool) and v > 0

    if shard_size is None and batch_size is None:
        raise ValueError("no size given: pass shard_size or batch_size")
    if shard_size is not None and batch_size is not None:
        if not (positive(shard_size) and positive(batch_size)):
            raise ValueError("shard_size and batch_size are positive integers")
        size = min(shard_size, batch_size)
        if shard_size != batch_size:
            warnings.warn(f"shard_size {shard_size} and batch_size {batch_size} differ; using {size}")
        return size, size
    size = shard_size if shard_size is not None else batch_size
    if not positive(size):
        raise ValueError("a size is a positive integer")
    return size, size


def validate_worker(worker: int, replicas: int, shard_size: int | None = None) -> None:
    """``worker`` must lie in ``[0, replicas)``; several replicas need a shard size. [C11]"""
    if worker is None or replicas is None:
        raise ValueError("worker and replicas go together: pass both")
    if not (0 <= worker < replicas):
        raise ValueError(f"worker {worker} is not one of the workers 0..{replicas - 1}")
    if replicas > 1 and not shard_size:
        raise ValueError("several replicas need a shard_size")


def check_range(row_count: int, start: int, end: int) -> None:
    """Both range ends must address an existing row: ``0 <= start, end < row_count``. [C2]"""
    for label, v in (("start", start), ("end", end)):
        if not (0 <= v < row_count):
            raise ValueError(f"{label} {v} is outside the rows 0..{row_count - 1}")


def max_shards_for_epochs(row_count: int, shard_size: int, replicas: int = 1,
                          epochs: float = 1.0) -> int:
    """Steps per worker so that all workers together cover the data ``epochs`` times."""
    return max(1, math.ceil(epochs * row_count / (replicas * shard_size)))


def assign_shards(indexed: DataFrame, row_count: int, shard_size: int, replicas: int = 1,
                  max_shards: int | None = None, worker: int | None = None,
                  row_idx: str = "row_idx", first_step: int = 0) -> DataFrame:
    """Tag rows with ``worker, step, pos`` for steps ``first_step .. first_step+max_shards-1``
    of every worker. [C1, C5-C8]

    Output: ``worker INT, step BIGINT, pos BIGINT`` + the input columns; rows of a
    shard are ``pos`` 0..s-1 in read order. ``max_shards=0`` gives no rows; the
    unbounded feed (``max_shards=None``) lives in :mod:`shardwise.streaming.feed`.
    When the steps cover less than the whole table, a range filter on the index
    selects the rows they use (it reaches the Parquet scan of a materialised,
    index-sorted table).
    """
    if max_shards is None:
        raise ValueError("a batch plan needs max_shards; use streaming.feed for an unbounded feed")
    if isinstance(max_shards, bool) or int(max_shards) < 0:
        raise ValueError("max_shards must be a non-negative integer")
    if row_count <= 0:
        raise ValueError("the dataset has no rows")
    validate_worker(0 if worker is None else worker, replicas, shard_size)
    s, r, n = int(shard_size), int(replicas), int(row_count)
    p_lo = int(first_step) * r * s
    p_hi = p_lo + r * int(max_shards) * s
    idx = F.col(row_idx)
    if p_hi == p_lo:
        return _tag(indexed.withColumn("__p", F.lit(None).cast("long")).where(F.lit(False)), s, r, row_idx)
    base = indexed
    one_worker = _worker_rows(idx, n, s, r, worker, int(first_step), int(max_shards))
    if one_worker is not None:
        base = base.where(one_worker)
    elif p_hi - p_lo < n:
        lo, hi = p_lo % n, p_hi % n
        base = base.where((idx >= lo) & (idx < hi)) if lo < hi else base.where((idx >= lo) | (idx < hi))
    e_lo, e_hi = p_lo // n, (p_hi - 1) // n
    if e_lo == e_hi:
        positions = base.withColumn("__p", F.lit(e_lo * n) + idx)
    else:
        positions = (
            base.withColumn("__e", F.explode(F.sequence(F.lit(e_lo), F.lit(e_hi))))
            .withColumn("__p", F.col("__e") * F.lit(n) + idx)
            .drop("__e")
        )
    positions = positions.where((F.col("__p") >= F.lit(p_lo)) & (F.col("__p") < F.lit(p_hi)))
    out = _tag(positions, s, r, row_idx)
    if worker is not None:
        out = out.where(F.col("worker") == F.lit(worker))
    return out


# Row ranges spelled out in a single worker's filter; more steps share ranges.
_WORKER_RANGES = 64


def _worker_rows(idx, n: int, s: int, r: int, worker: int | None, first_step: int, steps: int):
    """Row filter for one worker's shards: the union of its ``[(k*r + w)*s, +s)``
    ranges modulo ``n``; ``None`` when it would not narrow the read.

    Beyond ``_WORKER_RANGES`` steps, neighbouring shards share one range from the
    first to the last of them; the rows in between are left to the exact filter.
    """
    if worker is None or r == 1 or s >= n:
        return None
    each = -(-steps // _WORKER_RANGES)
    if ((each - 1) * r + 1) * s >= n:
        return None
    cond = None
    for k in range(first_step, first_step + steps, each):
        a = (k * r + worker) * s
        width = (min(each, first_step + steps - k) - 1) * r * s + s
        lo, hi = a % n, (a + width) % n
        piece = (idx >= lo) & (idx < hi) if lo < hi else (idx >= lo) | (idx < hi)
        cond = piece if cond is None else cond | piece
    return cond


def shard(indexed: DataFrame, row_count: int, shard_size: int, step: int, worker: int = 0,
          replicas: int = 1, row_idx: str = "row_idx") -> DataFrame:
    """The rows of one shard (``worker``'s ``step``), ordered by ``pos``. [C1, C7]"""
    return assign_shards(indexed, row_count, shard_size, replicas, 1, worker, row_idx,
                         first_step=step).orderBy("pos")


def _tag(positions: DataFrame, s: int, r: int, row_idx: str) -> DataFrame:
    data_cols = [c for c in positions.columns if c != "__p"]
    return positions.select(
        F.expr(f"cast((__p div {s}L) % {r}L as int)").alias("worker"),
        F.expr(f"(__p div {s}L) div {r}L").alias("step"),
        (F.col("__p") % F.lit(s)).cast("long").alias("pos"),
        *data_cols,
    )


def shard_positions(row_count: int, start: int, size: int) -> list[tuple[int, int]]:
    """Split the positions ``[start, start+size)`` at multiples of ``row_count`` into
    ``[a, b)`` row ranges modulo ``row_count`` (``b <= a`` means wrap around). [C6]"""
    starts = list(range(start, start + size, row_count))
    ends = starts[1:] + [start + size]
    return [(a % row_count, b % row_count) for a, b in zip(starts, ends)]


def slice_rows(indexed: DataFrame, row_count: int, start: int, end: int,
               row_idx: str = "row_idx") -> DataFrame:
    """Rows of the range ``[start, end)``; with ``end <= start`` the tail from
    ``start`` and then the head up to ``end`` (wrap-around). A filter on the
    index — with a Parquet table sorted by ``row_idx`` it prunes row groups. [C5, C12]"""
    check_range(row_count, start, end)
    idx = F.col(row_idx)
    if end > start:
        return indexed.where((idx >= start) & (idx < end)).withColumn("seq", idx - F.lit(start))
    return indexed.where((idx >= start) | (idx < end)).withColumn(
        "seq", F.when(idx >= start, idx - F.lit(start)).otherwise(idx + F.lit(row_count - start)))


def read_spec(manifest: DataFrame, row_count: int, start: int, end: int) -> DataFrame:
    """Per object, which lines to read for the row range ``[start, end)``. [C3-C5]

    ``manifest``: ``id, start_idx, end_idx[, uri]``. The first object is the one
    holding row ``start``; the last is the highest-ordered object with
    ``start_idx <= end <= end_idx``. For ``end > start`` the objects between them
    give ``skiprows = max(0, start - start_idx)`` and
    ``numrows = min(end_idx, end) - (start_idx + skiprows)``; for ``end <= start``
    the objects from the first to the last are read to their end (``part`` 0)
    and then the objects from the head to the last one, from their top (``part``
    1). Output: ``part, seq, id, skiprows, numrows[, uri]`` with ``seq`` the read
    order. The manifest has one row per file, so the windows here run over files.
    """
    check_range(row_count, start, end)
    everything = Window.partitionBy()  # over the objects of the manifest
    ordered = manifest.withColumn(
        "__pos", F.row_number().over(Window.orderBy("id", "start_idx", "end_idx")) - 1)
    lo = F.min(F.when((F.col("start_idx") <= start) & (F.lit(start) < F.col("end_idx")), F.col("__pos")))
    hi = F.max(F.when((F.col("start_idx") <= end) & (F.lit(end) <= F.col("end_idx")), F.col("__pos")))
    ordered = ordered.withColumn("__first", lo.over(everything)).withColumn("__last", hi.over(everything))
    first, last = F.col("__first"), F.col("__last")
    extra = ["uri"] if "uri" in manifest.columns else []
    pos = F.col("__pos")
    skip_head = F.greatest(F.lit(0), F.lit(start) - F.col("start_idx"))
    if end > start:
        spec = ordered.where((pos >= first) & (pos <= last)).select(
            F.lit(0).alias("part"), pos.alias("__order"), "id",
            skip_head.alias("skiprows"),
            (F.least(F.col("end_idx"), F.lit(end)) - (F.col("start_idx") + skip_head)).alias("numrows"),
            *extra)
    else:
        head = ordered.where(pos >= first).select(
            F.lit(0).alias("part"), pos.alias("__order"), "id",
            skip_head.alias("skiprows"),
            (F.col("end_idx") - (F.col("start_idx") + skip_head)).alias("numrows"), *extra)
        tail = ordered.where(pos <= last).select(
            F.lit(1).alias("part"), pos.alias("__order"), "id",
            F.lit(0).cast("long").alias("skiprows"),
            (F.least(F.col("end_idx"), F.lit(end)) - F.col("start_idx")).alias("numrows"), *extra)
        spec = head.unionByName(tail)
    return spec.withColumn(
        "seq", (F.row_number().over(Window.orderBy("part", "__order")) - 1).cast("long")
    ).select("part", "seq", "id", F.col("skiprows").cast("long").alias("skiprows"),
             F.col("numrows").cast("long").alias("numrows"), *extra)

