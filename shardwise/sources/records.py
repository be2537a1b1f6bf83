"""CSV records with quoted line breaks, from objects that stay splittable.

A line break inside quotes belongs to the field, so a split cannot know by
itself whether it starts inside quotes. Every line is therefore read as a
function of that one bit: the state behind it if it starts outside, and if it
starts inside quotes. Functions compose, so

1. the lines of all splits are read in parallel with their functions (a line
   without a quote keeps the state and is not walked through);
2. a running composition within each stretch (the next ``STRETCH_LINES`` lines
   of a split) numbers its records for both possible starts, in one exchange by
   stretch, written once;
3. the stretches of an object (one row each) are composed in order, which gives
   every stretch its start;
4. lines that are whole records pass as they are; only the lines of records
   that span several are brought together, by record.

Quotes follow the usual rules: one opens a field only at its start, a doubled
one inside quotes stands for itself, and after the closing one the rest of the
field is taken as it stands. Records end at ``\\n`` or ``\\r\\n``; blank lines
between records are skipped, inside quotes they belong to the field. A record
has to fit into a task's memory. Quotes still open at the end of an object are
an error. The exchanges have a partition for every ``PARTITION_BYTES`` of the
objects at least, so a task reads a bounded part of them however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.rowindex import object_uri, written
from ..session import default_parallelism
from .csv import header_flag, resolve_uri

# Lines composed by one group of the exchange, and bytes of the objects for each of its partitions.
STRETCH_LINES = 1 << 14
PARTITION_BYTES = 64 << 20

QUOTE = '"'
OUTSIDE, INSIDE, CLOSED = 0, 1, 2  # CLOSED: behind a quote that ends the field unless another follows


def _walk(line: Column, start: int, sep: str) -> Column:
    """``state`` behind ``line`` and ``seps``, the separators outside of quotes, walking from quote to quote."""
    pieces = F.split(line, QUOTE, -1)
    count = F.size(pieces)
    marked = F.transform(pieces, lambda piece, k: F.struct(piece.alias("piece"), k.alias("k")))

    def step(acc: Column, x: Column) -> Column:
        state, piece, followed = acc["state"], x["piece"], x["k"] < count - 1
        opens = F.endswith(piece, F.lit(sep)) | ((x["k"] == 0) & (piece == "") & F.lit(start == OUTSIDE))
        outside = F.when(followed & opens, F.lit(INSIDE)).otherwise(F.lit(OUTSIDE))
        after = (F.when(state == INSIDE, F.when(followed, F.lit(CLOSED)).otherwise(F.lit(INSIDE)))
                 .when((state == CLOSED) & (piece == ""),
                       F.when(followed, F.lit(INSIDE)).otherwise(F.lit(CLOSED)))
                 .otherwise(outside))
        found = F.length(piece) - F.length(F.replace(piece, F.lit(sep), F.lit("")))
        return F.struct(after.alias("state"),
                        (acc["seps"] + F.when(state == INSIDE, F.lit(0)).otherwise(found)).alias("seps"))

    return F.aggregate(marked, F.struct(F.lit(start).alias("state"), F.lit(0).alias("seps")), step)


def state_behind(line: Column, start: int, sep: str = ",") -> Column:
    """1 if quotes are open behind ``line``, which begins outside (0) or inside (1) of quotes, else 0."""
    plain = ~F.contains(line, F.lit(QUOTE))
    return F.when(plain, F.lit(start)).otherwise((_walk(line, start, sep)["state"] == INSIDE).cast("int"))


def field_count(record: Column, sep: str = ",") -> Column:
    """Number of fields of a whole record; separators inside quotes do not count."""
    return _walk(record, OUTSIDE, sep)["seps"] + 1


def _behind(constant: str, swaps: str, start: Column | str) -> Column:
    """State behind a run of lines: the one it was set to, or the start; turned as often as it swapped."""
    first = F.col(start) if isinstance(start, str) else start
    return F.coalesce(F.col(constant), (first + F.col(swaps)) % 2)


def _composed(rows: DataFrame, window, start: str = "e0", end: str = "e1") -> DataFrame:
    """``constant`` (null: depends on the start) and ``swaps`` of the rows up to each one in ``window``."""
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swap = ((F.col(start) == 1) & (F.col(end) == 0)).cast("int")
    rows = rows.withColumn("turns", F.sum(swap).over(upto))
    last = F.last(F.when(F.col(start) == F.col(end), F.struct(F.col(start).alias("v"), "turns")),
                  ignorenulls=True).over(upto)
    rows = rows.withColumn("set_", last)
    return (rows.withColumn("constant", F.when(F.col("set_").isNotNull(), (
                F.col("set_.v") + F.col("turns") - F.col("set_.turns")) % 2).cast("int"))
            .withColumn("swaps", (F.col("turns") % 2).cast("int")).drop("turns", "set_"))


def _partitions(spark: SparkSession, glob: str, wanted: Column | None) -> int:
    """Partitions for an exchange of all lines: one for every ``PARTITION_BYTES`` of the objects (their listing)."""
    files = spark.read.format("binaryFile").load(resolve_uri(glob))
    if wanted is not None:
        files = files.where(wanted)
    return -(-(files.agg(F.sum("length")).first()[0] or 0) // PARTITION_BYTES)


def _spread(df: DataFrame, partitions: int, keys: list[str]) -> DataFrame:
    """``df`` dealt out by ``keys`` if Spark's own number of partitions is too small; else Spark does so later."""
    return df.repartition(partitions, *keys) if partitions > default_parallelism(df.sparkSession) else df


def lines_of(spark: SparkSession, glob: str, sep: str = ",", wanted: Column | None = None) -> DataFrame:
    """``path, block, mid, line, e0, e1``: the lines of all objects with their functions."""
    scan = spark.read.option("lineSep", "\n").text(resolve_uri(glob))
    if wanted is not None:
        scan = scan.where(wanted)
    lines = scan.select(object_uri().alias("path"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("mid"), F.col("value").alias("line"))
    return lines.withColumns({"e0": state_behind(F.col("line"), OUTSIDE, sep),
                              "e1": state_behind(F.col("line"), INSIDE, sep)})


def records(spark: SparkSession, glob: str, header="infer", sep: str = ",",
            wanted: Column | None = None) -> DataFrame:
    """``__path, __block, __mid, record``: every record of the objects as text, headers left out.

    ``__block`` is the split that the record starts in and ``__mid`` its number
    in there, so :func:`shardwise.functions.rowindex.with_csv_row_index` takes
    the frame as a tagged scan. ``wanted`` restricts the objects (a condition
    that Spark can prune files by).
    """
    group = ["path", "block", "stretch"]
    stretch = Window.partitionBy(*group).orderBy("mid")
    before = stretch.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blank = F.trim(F.translate("line", "\t\r", "  ")) == ""
    partitions = _partitions(spark, glob, wanted)
    scanned = lines_of(spark, glob, sep, wanted).withColumn("stretch", F.expr(f"mid div {STRETCH_LINES}"))
    lines = _composed(_spread(scanned, partitions, group), stretch)
    # Where a line begins, for both starts of its stretch, and how many records began up to it.
    for s in (OUTSIDE, INSIDE):
        begins = F.coalesce(F.lag(_behind("constant", "swaps", F.lit(s))).over(stretch), F.lit(s))
        lines = lines.withColumn(f"at{s}", begins)
    for s in (OUTSIDE, INSIDE):
        lines = lines.withColumn(f"n{s}", F.sum(((F.col(f"at{s}") == OUTSIDE) & ~blank).cast("long")).over(before))
    lines = written(lines.drop("e0", "e1"), "csv-states")

    # A row per stretch: its function and its records, composed in the order of the object.
    last = F.max_by(F.struct("constant", "swaps", "n0", "n1"), "mid")
    parts = lines.groupBy(*group).agg(last.alias("f")).select(*group, "f.*")
    in_object = Window.partitionBy("path").orderBy("block", "stretch")
    earlier = in_object.rowsBetween(Window.unboundedPreceding, -1)
    in_split = Window.partitionBy("path", "block").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"e0": _behind("constant", "swaps", F.lit(OUTSIDE)),
                               "e1": _behind("constant", "swaps", F.lit(INSIDE))}).drop("constant", "swaps")
    parts = _composed(parts, in_object).withColumn("end", _behind("constant", "swaps", F.lit(OUTSIDE)))
    parts = (parts.withColumn("start", F.coalesce(F.lag("end").over(in_object), F.lit(OUTSIDE)))
             .withColumn("own", F.when(F.col("start") == OUTSIDE, F.col("n0")).otherwise(F.col("n1")))
             .withColumn("records_before", F.coalesce(F.sum("own").over(earlier), F.lit(0)))
             .withColumn("split_before", F.coalesce(F.sum("own").over(in_split), F.lit(0)))
             # The record that a stretch starts in the midst of began in the last one with any.
             .withColumn("open", F.last(F.when(F.col("own") > 0, F.struct(
                 "block", (F.col("split_before") + F.col("own")).alias("n"))), ignorenulls=True).over(earlier)))
    parts = written(parts.select(*group, "start", "end", "records_before", "split_before", "open"), "csv-stretches")
    unclosed = parts.groupBy("path").agg(F.max_by("end", F.struct("block", "stretch")).alias("end")).where("end = 1")
    wrong = [r["path"] for r in unclosed.orderBy("path").limit(5).collect()]
    if wrong:
        raise ValueError(f"quotes are still open at the end of {', '.join(wrong)}")

    outside = F.col("start") == OUTSIDE
    placed = (lines.join(parts, group)
              .withColumn("at", F.when(outside, F.col("at0")).otherwise(F.col("at1")))
              .withColumn("behind", _behind("constant", "swaps", "start"))
              .withColumn("n", F.when(outside, F.col("n0")).otherwise(F.col("n1"))))
    placed = placed.where((F.col("at") == INSIDE) | ~blank)
    found = placed.select(
        F.col("path").alias("__path"),
        F.when(F.col("n") > 0, F.col("block")).otherwise(F.col("open.block")).alias("__block"),
        F.when(F.col("n") > 0, F.col("split_before") + F.col("n")).otherwise(F.col("open.n")).alias("__mid"),
        # Lines that go on from the stretch before belong to its last record, number n + records_before too.
        (F.col("records_before") + F.col("n") == 1).alias("first"),
        "at", "behind", "block", "mid", "line")
    if header_flag(header):
        found = found.where(~F.col("first"))
    whole = (F.col("at") == OUTSIDE) & (F.col("behind") == OUTSIDE)
    keys = ["__path", "__block", "__mid"]
    joined = _spread(found.where(~whole), partitions, keys).groupBy(*keys).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("block", "mid", "line"))), lambda x: x["line"]), "\n").alias("record"))
    # The carriage return of a line's end is no part of its record.
    return found.where(whole).select(*keys, F.col("line").alias("record")).unionByName(joined).withColumn(
        "record", F.regexp_replace("record", "\r$", ""))


def _options(sep: str) -> dict[str, str]:
    return {"sep": sep, "quote": QUOTE, "escape": QUOTE, "multiLine": "true", "mode": "PERMISSIVE"}


def infer_fields(rows: DataFrame, sep: str = ",") -> StructType:
    """Types of the records' fields from all of them: INT, BIGINT, DOUBLE, else STRING.

    The number of fields is that of the longest record. One aggregation.
    """
    fields = rows.agg(F.max(field_count(F.col("record"), sep))).first()[0] or 0
    names = [f"_c{i}" for i in range(fields)]
    if not names:
        return StructType([])
    parsed = rows.select(F.from_csv("record", ", ".join(f"{n} STRING" for n in names), _options(sep)).alias("r"))
    kinds = ("int", "bigint", "double")
    fits = parsed.select("r.*").agg(*[
        F.bool_and(F.when(F.col(n).isNotNull(), F.col(n).try_cast(k).isNotNull())).alias(f"{n}_{k}")
        for n in names for k in kinds]).first()
    chosen = [next((k for k in kinds if fits[f"{n}_{k}"]), "string") for n in names]
    return StructType.fromDDL(", ".join(f"{n} {k}" for n, k in zip(names, chosen)))


def tagged_records(spark: SparkSession, glob: str, header="infer", sep: str = ",", schema=None,
                   wanted: Column | None = None) -> DataFrame:
    """The objects' rows with ``__path, __block, __mid`` (as ``rowindex.tag_scan`` gives them), written once.

    ``schema`` (DDL or a ``StructType``) names the fields; without one they are
    called ``_c0, _c1, ...`` and their types found in a pass over the records.
    """
    found = records(spark, glob, header, sep, wanted)
    if schema is None:
        found = written(found, "csv-records")
        schema = infer_fields(found, sep)
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if not fields.fields:
        raise ValueError(f"the objects of {glob} have no record to take fields from")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.fields)
    row = F.from_csv("record", ddl, _options(sep))
    out = found.withColumn("row", row)
    return written(out.select(*[F.col(f"row.`{f.name}`").alias(f.name) for f in fields.fields],
                              "__path", "__block", "__mid"), "csv-rows")
