"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import default_parallelism, scratch_path

# Fixed value: ASCII white space, the separator class of words and line ends.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark (the path may be on any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back.

    Cuts the lineage: executors lost later do not recompute what came before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that their names cannot clash with working columns."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def row_place(df: DataFrame) -> tuple[DataFrame, Column, Column]:
    """``df`` with its rows' file and place in the file, which name a row for good.

    A frame that is no scan of files is written first.
    """
    try:
        place = df.metadataColumn("_metadata")
        df.select(place["file_path"], place["row_index"])
    except AnalysisException:
        df = materialize(df, "rows")
        place = df.metadataColumn("_metadata")
    return df, place["file_path"], place["row_index"]


def partitions(spark: SparkSession) -> int:
    return default_parallelism(spark)


def worker_cache(key, make: Callable[[], object]):
    """An object that a Python worker keeps for all tasks it runs; ``make`` must bound its size."""
    kept = sys.__dict__.setdefault("_shardwise_worker_cache", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def free_worker_cache() -> None:
    """Drop what tasks of other operators left in this Python worker, which Spark uses again."""
    sys.__dict__.pop("_shardwise_worker_cache", None)


def column_blocks(batches: Iterator, rows: int = 512) -> Iterator:
    """Cut Arrow batches so that a step holds a bounded number of texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside hands Python at most ``rows`` rows at a time (fewer, if the session says so).

    Spark's 10,000 rows of long texts are held by the JVM and by the worker, twice each.
    """
    given = spark.conf.get(ARROW_ROWS)
    if not 0 < int(given) <= rows:
        spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, given)


# ---------------------------------------------------------------- running sums

def running_before(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str],
                   weight: Column, out: str, n_rows: int, rows_per_cell: int = 1024) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over earlier rows with the same ``keys``.

    ``order`` names a column of lower-case hex digits spread evenly (a digest);
    rows are ordered by it, then by ``ties``. No window holds a whole key: the
    first digits of the digest cut every key into cells of about
    ``rows_per_cell`` rows, cell sums are added up two digits at a time in
    windows of at most 256 rows, and only the rows of a cell meet in the last
    window. Rows equal in ``order`` and ``ties`` may swap places.
    """
    digits = 2
    while digits < 16 and n_rows / 16 ** digits > rows_per_cell:
        digits += 2
    work = df.withColumn("__w", weight).withColumn("__p", F.substring(F.col(order), 1, digits))
    sums = {digits: work.groupBy(*keys, "__p").agg(F.sum("__w").alias("__s"))}
    for level in range(digits - 2, 0, -2):
        sums[level] = (sums[level + 2].withColumn("__p", F.substring("__p", 1, level))
                       .groupBy(*keys, "__p").agg(F.sum("__s").alias("__s")))
    offsets = None
    for level in range(2, digits + 1, 2):
        upper = F.substring("__p", 1, level - 2)
        cell = (Window.partitionBy(*keys, "__u").orderBy("__p")
                .rowsBetween(Window.unboundedPreceding, -1))
        here = (sums[level].withColumn("__u", upper)
                .withColumn("__o", F.coalesce(F.sum("__s").over(cell), F.lit(0))))
        if offsets is not None:
            prev = offsets.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                                  F.col("__p").alias("__pp"), F.col("__o").alias("__oo"))
            on = F.col("__u") == F.col("__pp")
            for i, k in enumerate(keys):
                on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
            here = here.join(prev, on).withColumn("__o", F.col("__o") + F.col("__oo"))
        offsets = here.select(*keys, "__p", "__o")
    cells = offsets.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                           F.col("__p").alias("__cp"), F.col("__o").alias("__co"))
    on = F.col("__p") == F.col("__cp")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = (Window.partitionBy(*keys, "__p").orderBy(order, *ties)
              .rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(F.sum("__w").over(inside), F.lit(0)) + F.col("__co")
    names = [f"__k{i}" for i in range(len(keys))]
    return work.join(cells, on).withColumn(out, before).drop("__w", "__p", "__cp", "__co", *names)


# -------------------------------------------------------- connected components

def _edge_mark(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every vertex of ``edges (a, b)``: the smallest vertex reachable.

    Alternating large-star and small-star steps: every step replaces a vertex's
    links by links to the smallest vertex it sees, so stars form in a number of
    rounds logarithmic in the vertex count. Each step is an aggregation with
    partial sums and an equi-join (a vertex with very many links is split by
    Spark's skew join); each round is written out, so lost executors cost one
    round. The driver sees a count and a checksum per round.
    """
    def low(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def norm(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    current = materialize(norm(edges).distinct(), "cc")
    mark = _edge_mark(current)
    while mark[0]:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        mins = low(both).select("u", F.least("u", "m").alias("m"))
        # Large star: larger neighbours link to the smallest vertex around.
        large = norm(both.where("v > u").join(mins, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        large = materialize(large.distinct(), "cc")
        # Small star: the smaller neighbours and the vertex itself link to the smallest.
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        mins = low(down)
        small = down.join(mins, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            mins.select(F.col("u").alias("a"), F.col("m").alias("b")))
        nxt = materialize(norm(small).distinct(), "cc")
        new = _edge_mark(nxt)
        current = nxt
        if new == mark:
            break
        mark = new
    stars = current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    centres = current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return stars.union(centres)
