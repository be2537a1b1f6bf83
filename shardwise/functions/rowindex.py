"""Global row index ``row_idx`` in ``[0, N)`` without a single-partition window.

A DataFrame has no row order, yet sharding addresses rows by a global index.
Three ways to get one, all of them distributed:

* :func:`with_row_index` — by a sort key: the rows are range-partitioned and
  sorted, written once, counted per written range, and numbered by the range's
  running total plus the row's place in its file.
* :func:`with_parquet_row_index` — physical order of Parquet files:
  ``_metadata.row_index`` plus the file's ``start_idx`` from the manifest.
* :func:`with_csv_row_index` — physical order of CSV files: the scan is tagged
  with file, split and place and written once; splits are counted on that copy,
  so the numbers hold whatever later file-split settings are.

Running totals are small tables (a row per range, file or split) that are
written and joined; Spark broadcasts them only below its own size threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from ..session import default_parallelism, scratch_path

# Rows per key range when the caller gives no number of ranges.
ROWS_PER_RANGE = 1_000_000


def _cols(cols: str | Column | Sequence[str | Column]) -> list[Column]:
    if isinstance(cols, (str, Column)):
        cols = [cols]
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared checkpoint folder and read back."""
    path = scratch_path(df.sparkSession, name)
    # One file per task: places in a file are places in its range.
    df.write.option("maxRecordsPerFile", 0).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_digest(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed: rows it does not tell apart look the same."""
    names = [f.name for f in df.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in names])


def object_uri() -> Column:
    """The file of a scanned row: ``_metadata.file_path`` with one slash where there is no authority."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^([A-Za-z0-9+.-]+):///", "$1:/")


def number_of_ranges(spark, n_rows: int) -> int:
    """At least two, one per shuffle partition, and no more than ``ROWS_PER_RANGE`` rows each on average."""
    return max(2, default_parallelism(spark), -(-n_rows // ROWS_PER_RANGE))


def with_row_index(df: DataFrame, order_by, name: str = "row_idx", *,
                   num_ranges: int | None = None, tiebreak: str | None = None,
                   return_count: bool = False):
    """Add ``name`` = 0-based rank of each row in ``order_by`` order (ascending, nulls first).

    The range key is the sort key, then ``tiebreak`` (a column) or a hash of the
    whole row, then the row's place in its input partition, so that a key value
    (null too) with very many rows spreads over several ranges. Rows equal in
    key and tie-breaker may come in any order among themselves. The sorted
    ranges are written once; nothing later depends on partition bounds, adaptive
    execution or retried tasks. The input should be a deterministic scan.
    Returns the frame, or ``(frame, N)`` with ``return_count=True``.
    """
    spark = df.sparkSession
    keys = _cols(order_by)
    n_rows = df.count()
    configured = spark.conf.get("shardwise.rowindex.buckets", None)
    ranges = num_ranges or (int(configured) if configured else number_of_ranges(spark, n_rows))
    tie = F.col(tiebreak) if tiebreak is not None else row_digest(df)
    work = df.withColumns({f"__k{i}": k for i, k in enumerate(keys)}).withColumns(
        {"__tie": tie, "__mid": F.monotonically_increasing_id()})
    order = [f"__k{i}" for i in range(len(keys))] + ["__tie", "__mid"]
    sorted_ = work.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    data = written(sorted_.select(*[F.col(f"`{c}`") for c in df.columns],
                                  F.spark_partition_id().alias("__part")), "row-index")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(data.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")), "row-index-starts")
    out = (data.withColumn("__ri", F.col("_metadata.row_index")).join(starts, "__part")
           .withColumn(name, F.col("__start") + F.col("__ri")).drop("__part", "__start", "__ri"))
    return (out, n_rows) if return_count else out


def with_parquet_row_index(scan: DataFrame, manifest: DataFrame, name: str = "row_idx",
                           uri_col: str = "uri") -> DataFrame:
    """Physical order for a Parquet scan: ``start_idx`` of the file + ``_metadata.row_index``.

    ``scan`` must be the DataFrame returned by ``spark.read.parquet`` (so that the
    hidden ``_metadata`` column resolves); ``manifest`` has ``uri, start_idx``,
    one row per file, with URIs as :func:`object_uri` gives them. A file
    that the manifest doesn't name raises an error.
    """
    files = manifest.select(F.col(uri_col).alias("__uri"), F.col("start_idx").alias("__start"))
    known = F.coalesce("__start", F.raise_error(F.concat(F.lit("no manifest row for "), "__path")).cast("long"))
    return (
        scan.withColumn("__path", object_uri())
        .withColumn("__ri", F.col("_metadata.row_index"))
        .join(files, F.col("__path") == F.col("__uri"), "left")
        .withColumn(name, known + F.col("__ri"))
        .drop("__path", "__uri", "__ri", "__start")
    )


def tag_rows(scan: DataFrame) -> DataFrame:
    """The scan with file, split and place in its task."""
    return (scan.withColumn("__path", object_uri())
            .withColumn("__block", F.col("_metadata.file_block_start"))
            .withColumn("__mid", F.monotonically_increasing_id()))


def tag_scan(scan: DataFrame) -> DataFrame:
    """:func:`tag_rows`, written once.

    Counts and positions are both taken from this copy, so they agree even if
    another scan of the same objects would be split differently.
    """
    return written(tag_rows(scan), "tagged-scan")


def split_counts(tagged: DataFrame) -> DataFrame:
    """Rows per file split of a tagged scan: ``__path, __block, __n, __first``."""
    return written(tagged.groupBy("__path", "__block").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first")), "splits")


def check_counts(splits: DataFrame, manifest: DataFrame, uri_col: str = "uri") -> None:
    """Raise unless every object has as many rows as its manifest interval says."""
    counted = splits.groupBy(F.col("__path").alias("__u")).agg(F.sum("__n").alias("__c"))
    wanted = manifest.where(F.col(uri_col).isNotNull()).groupBy(F.col(uri_col).alias("__v")).agg(
        F.sum(F.col("end_idx") - F.col("start_idx")).alias("__w"))
    wrong = (counted.join(wanted, F.col("__u") == F.col("__v"), "full")
             .where(F.coalesce("__c", F.lit(0)) != F.coalesce("__w", F.lit(0)))
             .select(F.coalesce("__u", "__v").alias("uri"), "__c", "__w").orderBy("uri").limit(5).collect())
    if wrong:
        raise ValueError("rows read and rows in the manifest differ: " + "; ".join(
            f"{r['uri']}: {r['__c'] or 0} read, {r['__w'] or 0} in the manifest" for r in wrong))


def with_csv_row_index(scan: DataFrame, manifest: DataFrame | None = None,
                       name: str = "row_idx", uri_col: str = "uri",
                       tagged: DataFrame | None = None, splits: DataFrame | None = None) -> DataFrame:
    """Physical order for a CSV (or any text) scan.

    Order is file path order (or the manifest's ``start_idx`` when given), then
    split offset, then line order. ``scan`` must be the DataFrame returned by the
    reader; ``tagged`` (see :func:`tag_scan`) and ``splits`` (of it) save a pass
    when the objects were counted before. With a manifest the counts of all its
    objects are compared first; a difference is an error.
    """
    tagged = tag_scan(scan) if tagged is None else tagged
    splits = split_counts(tagged) if splits is None else splits
    if manifest is not None:
        check_counts(splits, manifest, uri_col)
        starts = manifest.select(F.col(uri_col).alias("__path"), F.col("start_idx").alias("__fstart"))
        in_file = Window.partitionBy("__path").orderBy("__block").rowsBetween(
            Window.unboundedPreceding, -1)
        offsets = splits.join(starts, "__path").withColumn(
            "__off", F.col("__fstart") + F.coalesce(F.sum("__n").over(in_file), F.lit(0)))
    else:
        # One row per file split: the global window is over a small table, never over data rows.
        before = Window.orderBy("__path", "__block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = splits.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    offsets = written(offsets.select("__path", "__block", "__first", "__off"), "split-offsets")
    return (
        tagged.join(offsets, ["__path", "__block"])
        .withColumn(name, F.col("__off") + F.col("__mid") - F.col("__first"))
        .drop("__path", "__block", "__mid", "__first", "__off")
    )
