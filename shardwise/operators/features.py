"""Numeric feature vectors, standardisation and fixed-size batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_double, numeric_columns

# The normalisation constants of the reference's image example.
IMAGE_MEAN = 0.1307
IMAGE_STD = 0.3081


def feature_vector(df: DataFrame, columns: Sequence[str] | None = None, name: str = "features",
                   keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns + ``name`` = ARRAY<DOUBLE> of the numeric columns, in column order. [D1, D3]

    Raises ``ValueError`` when no numeric column is left (e.g. a header line read
    as data made every column text).
    """
    cols = list(columns) if columns is not None else numeric_columns(df, exclude=keep)
    if not cols:
        raise ValueError(
            "Failed data type conversion: no numeric column; use header='infer' or "
            "header=True if the dataset has a header")
    return df.select(*keep, F.array(*[as_double(c) for c in cols]).alias(name))


def shard_matrices(sharded: DataFrame, features: str = "features",
                   keys: Sequence[str] = ("worker", "step")) -> DataFrame:
    """One dense matrix (ARRAY<ARRAY<DOUBLE>>, rows in ``pos`` order) per shard. [D2]

    A group holds one shard, so its size is bounded by ``shard_size``.
    """
    rows = F.sort_array(F.collect_list(F.struct(F.col("pos"), F.col(features).alias("f"))))
    return sharded.groupBy(*keys).agg(
        F.transform(rows, lambda r: r["f"]).alias("matrix"),
        F.count(F.lit(1)).alias("rows"))


def standardize(df: DataFrame, columns: Sequence[str], mean: float = IMAGE_MEAN,
                std: float = IMAGE_STD) -> DataFrame:
    """``(x - mean) / std`` with constants, applied to the given columns. [D4]"""
    exprs = {c: ((as_double(c) - F.lit(mean)) / F.lit(std)) for c in columns}
    return df.withColumns(exprs)


def standardize_array(col: Column | str, mean: float = IMAGE_MEAN, std: float = IMAGE_STD) -> Column:
    """Element-wise ``(x - mean) / std`` of an array column. [D4]"""
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(c, lambda x: (x - F.lit(mean)) / F.lit(std))


def fit_standardizer(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample standard deviation per column from one aggregation. [D4]

    The result is one row (two numbers per column), read on the driver like any
    fitted model's parameters.
    """
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.avg(as_double(c)).alias(f"m{i}"), F.stddev_samp(as_double(c)).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def apply_standardizer(df: DataFrame, params: dict[str, tuple[float, float]],
                       suffix: str = "") -> DataFrame:
    """Standardise with fitted parameters; a zero or missing deviation yields null. [D4]"""
    exprs = {}
    for c, (m, s) in params.items():
        exprs[c + suffix] = (
            (as_double(c) - F.lit(m)) / F.lit(s) if s not in (None, 0.0) else F.lit(None).cast("double"))
    return df.withColumns(exprs)


def assign_batches(indexed: DataFrame, batch_size: int, row_idx: str = "row_idx",
                   name: str = "batch") -> DataFrame:
    """``batch = row_idx div batch_size`` and ``batch_pos`` inside it; the last batch may be short. [D5]"""
    if not isinstance(batch_size, int) or batch_size <= 0:
        raise ValueError("batch_size is a positive integer")
    return indexed.withColumn(name, F.expr(f"`{row_idx}` div {batch_size}L")).withColumn(
        "batch_pos", (F.col(row_idx) % F.lit(batch_size)).cast("long"))


# Batch sizes of the reference's example trainer.
DEFAULT_BATCH_SIZES = {"train": 64, "test": 1000, "validation": 1000}


def assign_split_batches(df: DataFrame, split: str, order_by, sizes: dict[str, int] | None = None,
                         name: str = "batch") -> DataFrame:
    """Batches inside each split (e.g. train / test / validation), each with its own size. [D5]

    One global row index over ``(split, order_by...)``; the first index of every
    split (one row per split) is subtracted, then ``batch = idx div size``.
    Splits missing from ``sizes`` get no batch (null).
    """
    from ..functions.rowindex import with_row_index

    sizes = dict(sizes or DEFAULT_BATCH_SIZES)
    keys = [split] + ([order_by] if isinstance(order_by, str) else list(order_by))
    idx = with_row_index(df, keys, "__gidx")
    # one row per split named in ``sizes``: a broadcast of known size
    starts = idx.where(F.col(split).isin(list(sizes))).groupBy(split).agg(
        F.min("__gidx").alias("__start"))
    size = F.coalesce(*[F.when(F.col(split) == F.lit(k), F.lit(v)) for k, v in sizes.items()])
    return (
        idx.join(F.broadcast(starts), split, "left")
        .withColumn("row_idx", F.col("__gidx") - F.col("__start"))
        .withColumn("__size", size.cast("long")).withColumn(name, F.expr("row_idx div __size"))
        .withColumn("batch_pos", (F.col("row_idx") % size).cast("long"))
        .drop("__gidx", "__start", "__size")
    )


def batch_summary(batched: DataFrame, name: str = "batch", row_idx: str = "row_idx",
                  by: Sequence[str] = ()) -> DataFrame:
    """Rows and index range per batch, of each split if ``by`` names its column. [D5]"""
    return batched.groupBy(*by, name).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(row_idx).alias("first_row"),
        F.max(row_idx).alias("last_row"))
