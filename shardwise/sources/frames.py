"""pandas to Spark."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def pandas_to_spark(spark: SparkSession, pdf: pd.DataFrame, save_index: bool = True) -> DataFrame:
    """``createDataFrame`` of a pandas frame (Arrow path); the index is kept as a
    leading column unless ``save_index=False``. Meant for small driver-side tables
    such as a population summary. [A11]"""
    frame = pdf.reset_index() if save_index else pdf
    frame = frame.rename(columns={c: str(c) for c in frame.columns})
    return spark.createDataFrame(frame)
