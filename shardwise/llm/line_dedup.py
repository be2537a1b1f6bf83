"""Line dedup with levelled sorted runs.

A line's key is the line stripped of ASCII white space with A-Z lower-cased. The
runs hold the hashes (128 bits) of all keys seen so far, each run sorted and
bucketed by hash. A batch of documents is handled by

* pre-aggregating its keys to one row each, with the smallest id holding it,
* merge-anti-joining these with every run (only the batch is shuffled: runs are
  already dealt and sorted by the join key),
* writing the fresh keys as a new run of level 0.

When a level has ``FANOUT`` runs they are merged into one run of the next, so
the number of runs stays logarithmic in the number of batches. Batches come in
order of id, so a key in a run belongs to a smaller id.

Only DataFrame functions are used. Runs and intermediate tables lie in the
shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import materialize, partitions, whole_row

LEAST_CHARS = 10
BATCHES = 4
FANOUT = 2
BUCKET_ROWS = 8_000_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def lines_of(text: Column) -> Column:
    """All lines of a text; a null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_hash(key: Column) -> Column:
    """128 bits of a key as two longs: equal hashes are taken as equal keys."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


class Runs:
    """Levelled sorted runs of key hashes, as bucketed tables in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, rows: int = 0):
        self.spark, self.fanout = spark, fanout
        # Of so many rows in all, a bucket gets a bounded share.
        self.buckets = min(100_000, max(partitions(spark), -(-rows // BUCKET_ROWS)))
        self.levels: list[list[str]] = []

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (keys.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2")
         .sortBy("h1", "h2").option("path", scratch_path(self.spark, "line-run")).saveAsTable(name))
        return name

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> None:
        """Write ``keys (h1, h2)`` as a run of level 0 and merge full levels."""
        new, at = self._write(keys), 0
        while True:
            if at == len(self.levels):
                self.levels.append([])
            self.levels[at].append(new)
            if len(self.levels[at]) < self.fanout:
                return
            full, self.levels[at] = self.levels[at], []
            merged = self.spark.table(full[0])
            for name in full[1:]:
                merged = merged.unionByName(self.spark.table(name))
            new, at = self._write(merged), at + 1
            for name in full:
                self.spark.sql(f"DROP TABLE {name}")

    def close(self) -> None:
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def dropped_keys(keys: DataFrame, runs: Runs) -> DataFrame:
    """Of a batch ``keys (id, h1, h2)``: the rows whose lines go. Adds the batch to the runs.

    A row stays when no run holds its key and no smaller id of the batch does.
    """
    first = keys.groupBy("h1", "h2").agg(F.min("id").alias("id"))
    for run in runs.tables():
        first = first.join(run.hint("merge"), ["h1", "h2"], "left_anti")
    first = materialize(first, "line-fresh")
    runs.add(first.select("h1", "h2"))
    # The id is part of the join key, so a line of very many documents is spread.
    return keys.join(first, ["h1", "h2", "id"], "left_anti")


def duplicate_lines(docs: DataFrame, text: str, id_col: str, least: int = LEAST_CHARS,
                    batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``id, digest, gone``: for every text that loses lines, their places (from 0)."""
    key = F.col("key")
    lines = materialize(
        docs.where(F.col(id_col).isNotNull())
        # The digest is taken below the lines: above them it would be taken again for each.
        .select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), lines_of(F.col(text)).alias("lines"))
        .select("id", "digest", F.posexplode("lines").alias("pos", "line"))
        .select("id", "digest", "pos", line_key(F.col("line")).alias("key")).where(F.char_length(key) >= least)
        .select("id", "digest", "pos", key_hash(key).alias("h")).select("id", "digest", "pos", "h.h1", "h.h2"),
        "line-places")
    keys = materialize(lines.select("id", "h1", "h2").distinct(), "line-keys")
    cuts, rows = keys.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000).alias("c"),
                          F.count(F.lit(1))).first()
    edges = sorted(set(cuts or []))
    runs = Runs(docs.sparkSession, fanout, rows)
    gone = None
    try:
        for lo, hi in zip([None, *edges], [*edges, None]):
            batch = keys
            if lo is not None:
                batch = batch.where(F.col("id") >= lo)
            if hi is not None:
                batch = batch.where(F.col("id") < hi)
            part = materialize(dropped_keys(batch, runs), "line-gone")
            gone = part if gone is None else gone.unionByName(part)
    finally:
        runs.close()
    # Equal rows have equal places, so a set holds them once.
    return lines.join(gone, ["id", "h1", "h2"], "left_semi").groupBy("id", "digest").agg(
        F.collect_set("pos").alias("gone"))


def kept_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """Every row of ``docs`` as a struct ``given`` with its ``lines``, and ``gone``: the places dropped (or null)."""
    gone = duplicate_lines(docs.select(id_col, text), text, id_col, **options)
    rows = docs.select(whole_row(docs).alias("given"), F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"))
    return rows.join(gone, ["id", "digest"], "left").select(
        "given", lines_of(F.col("given")[text]).alias("lines"), "gone")


def remaining(lines: str, gone: str) -> Column:
    """The lines whose places are not among ``gone``, in order, in time linear in their number."""
    # The lambda variable holds the lines, so they are not split again for each of them.
    return F.transform(F.array(F.col(lines)), lambda own: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col(gone)), lambda i: F.get(own, i)))[0]


def drop_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` plus ``__lines`` (before) and ``__kept`` (the lines that stay, in order).

    Rows with a null id keep all lines and count for no other row; rows that
    repeat an id are one document. Ties do not arise: ids order the documents.
    Empty input gives no rows.
    """
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(remaining("lines", "gone"))
    return kept_lines(docs, text, id_col, **options).select("given", "lines", kept.alias("kept")).select(
        "given.*", F.col("lines").alias("__lines"), F.col("kept").alias("__kept"))


def kept_text() -> Column:
    """The text of a row of :func:`kept_lines` without its dropped lines; a null one is empty."""
    whole = F.coalesce(F.col("given.text"), F.lit(""))
    return F.when(F.col("gone").isNull(), whole).otherwise(F.array_join(remaining("lines", "gone"), "\n"))


def dedup_report(docs: DataFrame) -> DataFrame:
    """Per document: lines, lines dropped, and the digest of the kept text."""
    return kept_lines(docs.select("doc_id", "text")).select(
        "given.doc_id", F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept_text(), 256).alias("kept_sha256"))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with duplicate lines taken out of ``text`` (null stays null).

    A column ``n_chars`` follows the new text. Columns of any name come through.
    """
    own = {"text": F.col("kept").alias("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    text = F.when(F.col("given.text").isNotNull(), kept_text())
    return kept_lines(docs).select("given", text.alias("kept")).select(
        *[own.get(c, F.col(f"given.`{c}`")) for c in docs.columns])
