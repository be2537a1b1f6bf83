"""Bounded, repeatable samples of labelled texts for the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows kept out of training: crc32 of the id as text, modulo 5, equal to 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``doc_id, text, label`` of about ``rows`` labelled documents outside the held-out fold.

    Labels other than 0 and 1 and null ids are left out; an id labelled twice
    counts as 1 if any of its labels does. The ids with the smallest hashes are
    taken, so reruns agree; only that bounded list of ids is broadcast.
    """
    usable = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
              .where(~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")))
    n = usable.count()
    if n > rows:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    return docs.select("doc_id", F.col("text")).join(F.broadcast(usable), "doc_id").where(
        F.col("text").isNotNull())
