"""Shard manifests: rows per object turned into global offsets.

A raw manifest is ``id INT, count BIGINT`` (one row per object or partition).
The offset manifest adds the half-open interval ``[start_idx, end_idx)`` of
every object in the global row order: ``end_idx`` is the running total of
``count`` in ``id`` order. A manifest has one row per object, so the running
total is a window over objects, never over data rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rowindex import object_uri
from ..session import literal_rows

RAW_SCHEMA = "id INT, count BIGINT"


def partition_counts(df: DataFrame, include_empty_zero_id: bool = False) -> DataFrame:
    """Rows per partition of ``df`` as ``id, count`` (partitions without rows give no row). [B1, B2]

    ``include_empty_zero_id`` appends ``(0, 0)`` unconditionally, for writers that
    leave an empty first part file; id 0 may then appear twice, as in the
    reference. Take the counts from the very frame that is written (persist it
    first): adaptive execution may otherwise re-plan its partitions.
    """
    counts = (
        df.select(F.spark_partition_id().alias("id"))
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    if include_empty_zero_id:
        zero = literal_rows(df.sparkSession, [(0, 0)], RAW_SCHEMA)
        counts = counts.unionByName(zero)
    return counts


def check_raw_manifest(df: DataFrame) -> DataFrame:
    """The metadata source must have exactly the columns ``id`` and ``count``. [B4]"""
    if set(df.columns) != {"id", "count"}:
        raise ValueError(f"a raw manifest has the two columns id and count; this one has {df.columns}")
    return df


def read_raw_manifest(spark: SparkSession, path: str, header: bool = True, sep: str = ",") -> DataFrame:
    """Read a raw ``id,count`` manifest written as CSV. [A10]"""
    raw = spark.read.options(header=str(bool(header)).lower(), sep=sep, inferSchema="true").csv(path)
    if not header:
        raw = raw.toDF(*["id", "count"][: len(raw.columns)])
    check_raw_manifest(raw)
    return raw.select(F.col("id").cast("int").alias("id"), F.col("count").cast("long").alias("count"))


def make_manifest(spark: SparkSession | None = None, glob: str | None = None,
                  df: DataFrame | None = None, header: bool = True, sep: str = ",",
                  keep_count: bool = False) -> DataFrame:
    """Offset manifest ``id, start_idx, end_idx`` from a raw manifest DataFrame or CSV glob. [B5-B8]

    Rows are ordered by ``(id, count)``, so a duplicated id 0 with count 0 comes
    first and the offsets are deterministic.
    """
    if glob is None and df is None:
        raise ValueError("make_manifest needs a raw manifest: pass glob= or df=")
    if glob is not None:
        if spark is None:
            raise ValueError("reading a manifest glob needs a SparkSession")
        df = read_raw_manifest(spark, glob, header=header, sep=sep)
    check_raw_manifest(df)
    running = Window.orderBy("id", "count").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = (
        df.withColumn("end_idx", F.sum("count").over(running).cast("long"))
        .withColumn("start_idx", (F.col("end_idx") - F.col("count")).cast("long"))
    )
    cols = ["id", "start_idx", "end_idx"] + (["count"] if keep_count else [])
    return out.select(*cols)


def object_statuses(spark: SparkSession, glob: str) -> list[tuple[str, int, int]]:
    """``(uri, length, modification time)`` of the objects matching ``glob``, sorted by URI."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(glob)
    fs = path.getFileSystem(conf)
    files, hidden = [], []
    for st in fs.globStatus(path) or []:
        if st.isFile():
            uri = st.getPath().toUri()
            place = f"//{uri.getAuthority()}" if uri.getAuthority() else ""
            files.append((f"{uri.getScheme()}:{place}{uri.getRawPath()}", int(st.getLen()),
                          int(st.getModificationTime())))
            if st.getPath().getName().startswith(("_", ".")):
                hidden.append(files[-1][0])
    if not files:
        raise FileNotFoundError(f"no object matches {glob} (wrong pattern, or no permission to list it)")
    if hidden:
        raise ValueError(f"names starting with '_' or '.' cannot be read as data: {hidden[:5]}; "
                         "rename them or narrow the pattern")
    return sorted(files)


def list_objects(spark: SparkSession, glob: str) -> DataFrame:
    """Objects matching ``glob`` as ``id, uri, size``, sorted by ``uri``; ids are list positions. [A5, B9]

    Listing is metadata work on the driver, as Spark's own file index does it;
    zero-byte objects are listed too (Spark's readers drop them). URIs are escaped
    as those of scanned rows (``rowindex.object_uri``), so that names with blanks
    or percent signs meet. Names starting with ``_`` or ``.`` are refused: Spark's readers
    would leave them out without a word.
    """
    rows = [(i, uri, size) for i, (uri, size, _) in enumerate(object_statuses(spark, glob))]
    return literal_rows(spark, rows, "id INT, uri STRING, size BIGINT")


def count_objects(spark: SparkSession, glob: str, header: bool | str | int | None = None,
                  sep: str = ",", listing: DataFrame | None = None,
                  multiline: bool = False, fmt: str = "csv") -> DataFrame:
    """Raw manifest ``id, count`` by counting the rows of every object (one scan). [B3, H2]

    ``id`` is the object's position in the sorted listing; zero-byte objects are
    skipped but keep their id (a gap), header-only objects count 0. Rows are
    counted per ``_metadata.file_path`` with partial aggregation, so the shuffle
    carries one row per object and task. ``multiline`` counts records whose
    quoted fields hold line breaks as one row. Of Parquet objects (``fmt``) no column
    is read: the row counts come from the footers.
    """
    from ..sources.csv import header_flag

    listing = listing if listing is not None else list_objects(spark, glob)
    if fmt == "csv":
        scan = spark.read.options(header=str(header_flag(header)).lower(), sep=sep,
                                  multiLine=str(bool(multiline)).lower()).csv(glob)
    else:
        scan = spark.read.format(fmt).load(glob)
    counts = scan.select(object_uri().alias("uri")).groupBy("uri").agg(
        F.count(F.lit(1)).alias("count"))
    return (
        listing.where(F.col("size") > 0)
        .join(counts, "uri", "left")
        .select("id", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))
    )


def attach_uris(manifest: DataFrame, listing: DataFrame, check: bool = True) -> DataFrame:
    """Pair the k-th manifest row (by ``id``) with the k-th object (by ``uri``). [B9-B11]

    When there are as many objects as manifest rows all are paired, empty ones
    too; else the zero-byte objects are left out first. If neither count fits,
    reading the result raises an error (``check=False``: rows without a partner
    go). Both sides have one row per object.
    """
    order = ["id", "start_idx", "end_idx"]
    left = manifest.select(*order, F.lit(None).cast("string").alias("uri"), F.lit(None).cast("long").alias("size"),
                           F.lit(0).alias("__side"))
    right = listing.select(*[F.lit(None).cast(manifest.schema[c].dataType).alias(c) for c in order],
                           "uri", F.col("size").cast("long"), F.lit(1).alias("__side"))
    everything = Window.partitionBy()
    by_order = Window.partitionBy("__side").orderBy(*order, "uri")
    is_object = F.col("__side") == 1
    full = is_object & (F.col("size") > 0)
    both = (left.unionByName(right)
            .withColumn("__k", F.row_number().over(by_order))
            .withColumn("__full", F.sum(full.cast("int")).over(by_order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("__rows", F.sum((~is_object).cast("int")).over(everything))
            .withColumn("__all", F.sum(is_object.cast("int")).over(everything))
            .withColumn("__nonempty", F.sum(full.cast("int")).over(everything)))
    fits = (F.col("__rows") == F.col("__all")) | (F.col("__rows") == F.col("__nonempty"))
    key = (F.when(~is_object | (F.col("__rows") == F.col("__all")), F.col("__k"))
           .when(full, F.col("__full")))
    if check:
        key = F.when(fits, key).otherwise(F.raise_error(F.concat(
            F.lit("the manifest has "), F.col("__rows").cast("string"), F.lit(" rows, but there are "),
            F.col("__all").cast("string"), F.lit(" objects, of them with content "),
            F.col("__nonempty").cast("string"))).cast("int"))
    pairs = both.withColumn("__key", key).where(F.col("__key").isNotNull()).groupBy("__key").agg(
        *[F.max(c).alias(c) for c in order], F.max("uri").alias("uri"))
    return pairs.where(F.col("id").isNotNull() & F.col("uri").isNotNull()).drop("__key")


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """One row ``obj_count, row_count`` (``row_count`` = the last ``end_idx``). [B12]"""
    return manifest.agg(
        F.count(F.lit(1)).alias("obj_count"),
        F.coalesce(F.max("end_idx"), F.lit(0)).cast("long").alias("row_count"),
    )


def build_manifest(spark: SparkSession, glob: str, header=None, sep: str = ",",
                   shards_glob: str | None = None,
                   make_manifest_fn: Callable[..., DataFrame] = make_manifest,
                   count_objects_fn: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Offset manifest with ``uri`` for the objects matching ``glob``. [A8, H1, H2]

    With ``shards_glob`` the raw manifest is read from there and paired with the
    objects by position; otherwise every object is counted and paired by path.
    Both hooks can be replaced (``make_manifest_fn(df=...)`` /
    ``make_manifest_fn(spark=..., glob=...)`` and
    ``count_objects_fn(spark, glob, header=...)``).
    """
    listing = list_objects(spark, glob)
    if shards_glob is not None:
        offsets = make_manifest_fn(spark=spark, glob=shards_glob)
        return attach_uris(offsets, listing)
    counter = count_objects_fn or count_objects
    raw = counter(spark, glob, header=header, sep=sep) if counter is not count_objects else \
        count_objects(spark, glob, header=header, sep=sep, listing=listing)
    offsets = make_manifest_fn(df=raw)
    return offsets.join(listing.select("id", "uri"), "id", "left").select(
        "id", "start_idx", "end_idx", "uri")
