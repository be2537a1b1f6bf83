"""Column selection helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType


def numeric_columns(df: DataFrame, exclude=(), booleans: bool = True) -> list[str]:
    """Names of the numeric columns; booleans count as numeric unless ``booleans=False``."""
    skip = set(exclude)
    kinds = (NumericType, BooleanType) if booleans else (NumericType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in skip]


def as_double(name: str):
    return F.col(f"`{name}`").cast("double")


def round_half_away(col, digits: int = 6):
    """Round a DOUBLE to ``digits`` places, halves away from zero, in double
    arithmetic (``sign(s) * floor(|s| + 0.5) / 10^digits`` with ``s = x * 10^digits``).

    Built-in ``round`` goes through BigDecimal per value; this stays in
    arithmetic that whole-stage code generation keeps tight. ``floor`` is taken
    as ``y - y % 1`` so that large values never pass through a 64-bit integer.
    """
    c = F.col(col) if isinstance(col, str) else col
    scale = float(10 ** digits)
    s = c.cast("double") * F.lit(scale)
    y = F.abs(s) + F.lit(0.5)
    rounded = F.signum(s) * (y - y % F.lit(1.0)) / F.lit(scale)
    return F.when(F.abs(c) == F.lit(float("inf")), c.cast("double")).otherwise(rounded)
