"""CSV object sets: protocol and storage options, header modes, positional names."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

# Schemes the reference accepts, mapped to the Hadoop file system that serves them.
# s3 objects go through the S3A connector; file, hdfs and gs keep
# their scheme; http(s) has no Hadoop file system (land such files first).
SCHEME_MAP = {"s3": "s3a", "s3a": "s3a", "s3n": "s3a", "gs": "gs", "hdfs": "hdfs", "file": "file", "": ""}
ANONYMOUS_PROVIDER = "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"


def header_flag(header) -> bool:
    """Map the header argument to Spark's boolean option. [A6]

    ``'infer'``, ``0`` and ``True`` mean the first line of every object is a
    header; ``None`` and ``False`` mean there is none. Anything else is refused.
    """
    if header is None or header is False:
        return False
    if header is True or header == "infer" or (isinstance(header, int) and header == 0):
        return True
    raise ValueError(f"header={header!r} is none of infer, 0, True, None, False")


def resolve_uri(uri: str) -> str:
    """Rewrite the scheme of ``uri`` to the Hadoop file system that reads it. [A2]"""
    parsed = urlparse(uri)
    scheme = parsed.scheme.lower()
    if scheme in ("http", "https"):
        raise NotImplementedError(
            f"{uri}: there is no Hadoop file system for {scheme}; copy the object to "
            "shared storage (hdfs, s3, gs, file) and read it from there")
    if scheme not in SCHEME_MAP:
        return uri
    target = SCHEME_MAP[scheme]
    return uri if target == scheme else target + uri[len(scheme):]


def coerce_storage_options(options: dict | None) -> dict:
    """Anonymous access by default; a string ``'true'/'false'`` or any truthy value becomes bool. [A3]"""
    opts = dict(options) if options else {"anon": True}
    if "anon" in opts:
        value = opts["anon"]
        opts["anon"] = value.strip().lower() == "true" if isinstance(value, str) else bool(value)
    return opts


# Storage options and the Hadoop settings that stand for them.
S3_OPTIONS = {"key": "access.key", "secret": "secret.key", "token": "session.token", "endpoint": "endpoint"}
S3_CLIENT_OPTIONS = {"endpoint_url": "endpoint", "region_name": "endpoint.region"}
SESSION_PROVIDER = "org.apache.hadoop.fs.s3a.TemporaryAWSCredentialsProvider"
GS_KEYFILE = "fs.gs.auth.service.account.json.keyfile"


def storage_settings(uri: str, options: dict | None = None) -> dict[str, str]:
    """Hadoop settings for the storage options of ``uri``; unknown options are refused. [A3]

    ``s3``: ``anon, key, secret, token, endpoint, client_kwargs`` (``endpoint_url``
    and ``region_name``), for the bucket of the URI. ``gs``: ``anon``, and
    ``token`` as the path of a service account's key file. Other schemes take
    ``anon`` only, which changes nothing there.
    """
    opts = coerce_storage_options(options)
    parsed = urlparse(resolve_uri(uri))
    out: dict[str, str] = {}
    rest = {k: v for k, v in opts.items() if k != "anon"}
    if parsed.scheme == "s3a":
        prefix = f"fs.s3a.bucket.{parsed.netloc}."
        if opts.get("anon"):
            out[prefix + "aws.credentials.provider"] = ANONYMOUS_PROVIDER
        elif "token" in rest:
            out[prefix + "aws.credentials.provider"] = SESSION_PROVIDER
        client = dict(rest.pop("client_kwargs", None) or {})
        for names, given in ((S3_OPTIONS, rest), (S3_CLIENT_OPTIONS, client)):
            for key in [k for k in given if k in names]:
                out[prefix + names[key]] = str(given.pop(key))
        rest.update({f"client_kwargs.{k}": v for k, v in client.items()})
    elif parsed.scheme == "gs":
        if "token" in rest:
            out["fs.gs.auth.type"] = "SERVICE_ACCOUNT_JSON_KEYFILE"
            out[GS_KEYFILE] = str(rest.pop("token"))
        elif opts.get("anon"):
            out["fs.gs.auth.type"] = "UNAUTHENTICATED"
    if rest:
        raise ValueError(f"storage options not known for {parsed.scheme or 'local'} paths: {sorted(rest)}")
    return out


def apply_storage_options(spark: SparkSession, uri: str, options: dict | None = None) -> dict:
    """Put :func:`storage_settings` into the session's Hadoop settings; returns the options. [A3]"""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for key, value in storage_settings(uri, options).items():
        conf.set(key, value)
    return coerce_storage_options(options)


def positional(df: DataFrame) -> DataFrame:
    """Rename the columns to their positions ``0..n-1``. [A7]"""
    return df.toDF(*[str(i) for i in range(len(df.columns))])


def read_objects(spark: SparkSession, glob: str, header="infer", sep: str = ",",
                 schema=None, infer_schema: bool = True, sampling_ratio: float | None = None,
                 multiline: bool = False, positional_names: bool = True,
                 storage_options: dict | None = None, cache: bool = False) -> DataFrame:
    """Scan every CSV object matching ``glob`` as one DataFrame. [A1, A4-A7]

    ``schema`` avoids the inference pass (advised at scale); otherwise
    ``sampling_ratio`` bounds it. With ``positional_names`` the columns are named
    ``0..n-1`` as in the reference. ``cache`` keeps the scan on executors
    (memory, then disk) for repeated reads of remote objects. A glob matching
    nothing raises ``FileNotFoundError``.
    """
    path = resolve_uri(glob)
    apply_storage_options(spark, path, storage_options)
    reader = spark.read.options(header=str(header_flag(header)).lower(), sep=sep,
                                multiLine=str(bool(multiline)).lower())
    if schema is not None:
        reader = reader.schema(schema)
    elif infer_schema:
        reader = reader.option("inferSchema", "true")
        if sampling_ratio:
            reader = reader.option("samplingRatio", str(sampling_ratio))
    try:
        df = reader.csv(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(
                f"no object matches {glob} (wrong pattern, or no permission to list it)") from exc
        raise
    if positional_names:
        df = positional(df)
    if cache:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return df
