"""Score evaluation: log-softmax, negative log-likelihood, batch means.

The reference scores a model batch by batch; here a table of logits and labels
is scored in one job. Batches come from the global row index, the per-batch
losses from one aggregation, and the mean of batch means from a second,
tiny one (it differs from the row mean when the last batch is short).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import nll_of_scores


def row_losses(df: DataFrame, logits: str | Column, label: str, name: str = "loss") -> DataFrame:
    """Add ``name`` = NLL of ``label`` under ``log_softmax(logits)``. [F1, F2]"""
    arr = F.col(logits) if isinstance(logits, str) else logits
    return df.withColumn(name, nll_of_scores(arr, label))


def batch_losses(scored: DataFrame, batch: str = "batch", loss: str = "loss") -> DataFrame:
    """``batch, n_rows, loss`` = mean loss per batch. [F2]"""
    return scored.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(loss).alias("loss"))


def epoch_loss(batches: DataFrame, loss: str = "loss") -> DataFrame:
    """One row: unweighted mean of batch means, row-weighted mean, counts. [F3]"""
    return batches.agg(
        F.avg(loss).alias("mean_batch_loss"),
        (F.sum(F.col(loss) * F.col("n_rows")) / F.sum("n_rows")).alias("mean_row_loss"),
        F.count(F.lit(1)).alias("n_batches"),
        F.sum("n_rows").cast("long").alias("n_rows"))
