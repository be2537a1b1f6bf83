"""Metadata beside a data folder: ``.meta/shards/`` (raw manifest) and ``.meta/stats/``.

Both are CSV. Readers find them by convention next to the data objects; the
writers put a single CSV file there (the tables are one row per object and
five rows respectively, so one task writes them).
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import literal_rows
from .csv import resolve_uri


def parent_of(glob: str) -> str:
    """Folder holding the objects of ``glob`` (the part before the first wildcard)."""
    path = resolve_uri(glob)
    cut = min([i for i in map(path.find, "*?[{") if i >= 0], default=-1)
    if cut >= 0:
        path = path[:cut]
        return path.rsplit("/", 1)[0]
    return posixpath.dirname(path.rstrip("/"))


def _meta_files(spark: SparkSession, folder: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if st.isFile() and not name.startswith(("_", ".")) and st.getLen() > 0:
            out.append(st.getPath().toString())
    return sorted(out)


def find_meta(spark: SparkSession, glob: str, kind: str) -> str | None:
    """Folder ``<parent>/.meta/<kind>/`` when it holds CSV data, else ``None``. [A8, A9]"""
    folder = f"{parent_of(glob)}/.meta/{kind}"
    return folder if _meta_files(spark, folder) else None


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Stats table: ``summary`` + one DOUBLE column per numeric data column. [A9]"""
    df = spark.read.options(header="true", inferSchema="true").csv(path)
    if "summary" not in df.columns:
        raise ValueError(f"stats metadata at {path} has no summary column")
    return df.select("summary", *[F.col(c).cast("double").alias(c) for c in df.columns if c != "summary"])


def write_meta(df: DataFrame, data_folder: str, kind: str) -> str:
    """Write a small table (raw manifest or stats) as one CSV file in ``.meta/<kind>/``. [A12]

    The table is complete beside its place before it replaces the former one by rename,
    so readers find a whole table or none.
    """
    base = f"{resolve_uri(data_folder).rstrip('/')}/.meta"
    target, ready = f"{base}/{kind}", f"{base}/.{kind}-{uuid.uuid4().hex}"
    df.coalesce(1).write.option("header", "true").csv(ready)
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path(target), True)
    if not fs.rename(path(ready), path(target)):
        raise OSError(f"{ready} could not be renamed to {target}")
    return target


def write_manifest(raw_manifest: DataFrame, data_folder: str) -> str:
    """Store ``id, count`` for the objects of ``data_folder``. [A12]"""
    return write_meta(raw_manifest.select("id", "count"), data_folder, "shards")


def write_stats(stats_wide: DataFrame, data_folder: str) -> str:
    """Store a wide summary (``summary`` + columns) for ``data_folder``. [A12]"""
    return write_meta(stats_wide, data_folder, "stats")


def add_to_stats(added: DataFrame, data_folder: str) -> DataFrame:
    """Bring the stored stats of ``data_folder`` up to date with the rows of objects added to it. [A9, A12]

    Scans the added rows only. Without stored stats they are those of ``added``.
    The new table is complete before the stored one is replaced. Call it once for
    every set of objects: stats do not say which objects they cover.
    """
    from ..functions.rowindex import written
    from ..operators.stats import merge_summary, summary_wide

    spark = added.sparkSession
    path = find_meta(spark, f"{resolve_uri(data_folder).rstrip('/')}/*", "stats")
    new = summary_wide(added) if path is None else merge_summary(read_stats(spark, path), added)
    return read_stats(spark, write_stats(written(new, "stats"), data_folder))


def write_with_manifest(df: DataFrame, data_folder: str, fmt: str = "csv", header: bool = True,
                        include_empty_zero_id: bool = False, mode: str = "overwrite") -> DataFrame:
    """Write ``df`` as part files and its raw manifest (rows per part) to ``.meta/shards``. [B1, A12]

    ``df`` is computed once. The rows are counted on the parts that were written, so
    the manifest agrees with them whatever tasks were lost and run again on the way.
    ``id`` is a part's place among the files sorted by name, zero-byte ones not
    counted; with ``mode="append"`` the manifest covers the older files as well. The
    former manifest goes before the parts are written, and the new one is published
    when it is complete; in between readers find none and count for themselves.
    ``include_empty_zero_id`` adds ``(0, 0)`` for an empty first part without a
    file of its own. Returns the raw manifest.
    """
    from ..operators.manifest import RAW_SCHEMA, count_objects

    spark = df.sparkSession
    target = resolve_uri(data_folder).rstrip("/")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if mode == "append":
        fs.delete(path(f"{target}/.meta/shards"), True)
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", str(bool(header)).lower())
    writer.format(fmt).save(target)
    parts = f"{target}/part-*"
    written = any(st.getLen() > 0 for st in fs.globStatus(path(parts)) or [])
    if written:
        # Each part was written by one task, so reading it whole for quoted line breaks asks no more of one.
        raw = count_objects(spark, parts, header=header, multiline=True, fmt=fmt)
        places = Window.orderBy("id")  # a row per part
        raw = raw.select((F.row_number().over(places) - 1).alias("id"), "count")
    else:
        raw = literal_rows(spark, [], RAW_SCHEMA)
    if include_empty_zero_id:
        raw = raw.unionByName(literal_rows(spark, [(0, 0)], RAW_SCHEMA))
    write_manifest(raw, target)
    return read_raw(spark, f"{target}/.meta/shards")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.manifest import read_raw_manifest

    return read_raw_manifest(spark, path)
