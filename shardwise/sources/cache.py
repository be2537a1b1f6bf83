"""Read-through cache of data objects in a shared folder. [A4]

An object is known by its URI, length, modification time and the way it is read
(header, separator, record form, schema). The rows of objects not yet known are
read by one Spark job, which writes them on the executors, a folder for every
object; then one index file names them all. Until the index is published nobody
sees them, so a lost executor or a failed job leaves nothing half cached. Later
reads take known objects from the folder and touch their sources no more; an
object that has changed has no entry and is read again. Older versions stay until
the folder is deleted.

    <folder>/data/<fill>/__entry=<digest of the URI>/part-*.parquet
    <folder>/index/part-*.parquet    uri, size, modified, form, types, rows, fill
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from ..functions.rowindex import object_uri
from ..operators.manifest import object_statuses
from ..session import ensure_checkpoint_dir, literal_rows

INDEX = "uri STRING, size BIGINT, modified BIGINT, form STRING, types STRING, rows BIGINT, fill STRING"
#: Listings taken when objects keep changing while they are read.
ATTEMPTS = 3


def cache_folder(spark: SparkSession, cache: bool | str) -> str:
    """The folder named by ``cache``, or the one under ``spark.checkpoint.dir`` when it is True."""
    if isinstance(cache, str):
        return cache.rstrip("/")
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/shardwise-object-cache"


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _index(spark: SparkSession, folder: str, form: str) -> dict[tuple, list]:
    """Index rows of ``form`` by ``(uri, size, modified)``: a row per cached object version."""
    if not _exists(spark, f"{folder}/index"):
        return {}
    found: dict[tuple, list] = {}
    rows = spark.read.schema(INDEX).parquet(f"{folder}/index").where(F.col("form") == form)
    for r in rows.collect():
        found.setdefault((r["uri"], r["size"], r["modified"]), []).append(r)
    return found


def _fill(spark: SparkSession, folder: str, missing: list[tuple], form: str, types: str,
          read: Callable[[Column], DataFrame], glob: str) -> None:
    """Write the rows of the ``missing`` versions and publish those that did not change meanwhile."""
    fill = uuid.uuid4().hex
    target = f"{folder}/data/{fill}"
    wanted = object_uri().isin([uri for uri, _, _ in missing])
    entry = F.sha2("__path", 256)
    (read(wanted).withColumn("__entry", entry)
     .write.option("maxRecordsPerFile", 0).partitionBy("__entry").parquet(target))
    counts = {}
    written = spark.read.schema("__path STRING").parquet(target)
    for r in written.groupBy("__path").count().collect():  # a row per object
        counts[r["__path"]] = r["count"]
    same = set(object_statuses(spark, glob)) & set(missing)
    rows = [(*v, form, types, counts.get(v[0], 0), fill) for v in sorted(same)]
    if rows:
        literal_rows(spark, rows, INDEX).coalesce(1).write.mode("append").parquet(f"{folder}/index")


def cached_rows(spark: SparkSession, glob: str, form: dict, schema: StructType | None,
                infer: Callable[[], StructType], read: Callable[[Column], DataFrame],
                cache: bool | str = True, stretches: list[tuple] | None = None) -> DataFrame:
    """The tagged rows of the objects of ``glob`` (``__path, __block, __mid`` beside the data).

    ``read(wanted)`` gives tagged rows of the objects that the condition ``wanted``
    picks by file path. Without ``schema`` the types of the cached copy hold as long as all
    objects are cached with the same ones; else ``infer()`` reads the objects for
    them (give a schema to spare that). ``stretches`` restricts the objects to ranges of URIs.
    """
    folder = cache_folder(spark, cache)
    form_key = json.dumps(form, sort_keys=True)
    for _ in range(ATTEMPTS):
        versions = object_statuses(spark, glob)
        if stretches is not None:
            versions = [v for v in versions if any(lo <= v[0] <= hi for lo, hi in stretches)]
        index = _index(spark, folder, form_key)
        if schema is None:
            common = [{r["types"] for r in index.get(v, [])} for v in versions]
            common = sorted(set.intersection(*common)) if common else []
            schema = StructType.fromJson(json.loads(common[0])) if common else infer()
        types = json.dumps(schema.jsonValue(), sort_keys=True)
        known = {v: min((r for r in index.get(v, []) if r["types"] == types),
                        key=lambda r: r["fill"], default=None) for v in versions}
        missing = [v for v, row in known.items() if row is None]
        if not missing:
            break
        _fill(spark, folder, missing, form_key, types, read, glob)
    else:
        raise RuntimeError(f"objects of {glob} keep changing while they are read: {missing[:5]}")
    full = schema
    for name, kind in (("__path", StringType()), ("__block", LongType()), ("__mid", LongType())):
        full = StructType([*full.fields, *StructType().add(name, kind).fields])
    paths = [f"{folder}/data/{r['fill']}/__entry={hashlib.sha256(r['uri'].encode()).hexdigest()}"
             for r in known.values() if r["rows"]]
    if not paths:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(*paths)
