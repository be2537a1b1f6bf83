"""Vector columns: which rows take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, not empty, every component finite and not null, and not all zero."""
    v = F.col(vector)

    def finite(x: Column) -> Column:
        y = x.cast("double")
        return x.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf")))

    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) &
                      F.exists(v, lambda x: x != 0), F.lit(False))


def distinct_vectors(df: DataFrame, id_col: str, vector: str, *more: str) -> DataFrame:
    """Usable rows with an id; rows equal in all the columns named count once."""
    return df.where(F.col(id_col).isNotNull() & usable(vector)).select(id_col, vector, *more).distinct()


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def norms(x: np.ndarray) -> np.ndarray:
    """Row lengths, summed component by component."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * x[:, k]
    return np.sqrt(total)


def cosines(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``x`` with the rows of ``y``, in double precision.

    Summed component by component, so a pair has the same value in any block.
    """
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * y[:, k]
    return total / (nx * ny)
