"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1 (straight lines
between knots). The integral of the schedule is the source's weight; weights
share out the words of the mix, capped at a multiple of each source's size. The
same schedule says when a source's words are wanted: its cumulative demand at
time t is the integral up to t, as a share of the whole. A document's words
stand at some place of its source's word stream; the inverse of the cumulative
demand turns that place into a training position, and documents are range-sorted
by position.

Only DataFrame functions are used. Words before a document come from distributed
running sums (no window holds a whole source), the order within a source from a
digest of the id, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, row_place, running_before, whole_row

# Knots (time, weight); the integrals are 5, 2 and 1.
SCHEDULES = (
    ((0.0, 6.0), (1.0, 4.0)),
    ((0.0, 1.0), (1.0, 3.0)),
    ((0.0, 1.5), (1.0, 0.5)),
)
TOTAL_SHARE = 1.5
MOST_REPEATS = 2


def integral(knots: Sequence[tuple[float, float]]) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))


def _segments(knots: Sequence[tuple[float, float]]) -> Column:
    parts, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        parts.append(F.struct(F.lit(done).alias("c0"), F.lit(area).alias("area"), F.lit(t0).alias("t0"),
                              F.lit(w0).alias("w0"), F.lit((w1 - w0) / (t1 - t0)).alias("slope")))
        done += area
    return F.array(*parts)


def _of_rank(values: Sequence[Column], rank: Column) -> Column:
    return F.element_at(F.array(*values), ((rank - 1) % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, schedules=SCHEDULES, share: float = TOTAL_SHARE,
            repeats: float = MOST_REPEATS) -> DataFrame:
    """``source, source_size, rank, target`` for one row per source of ``sizes``.

    The words ``share * all sizes`` go out by weight; a source stops at
    ``repeats`` times its size and the excess is shared out again by weight,
    which ends at one water level: ``target = min(cap, weight * level)``.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filling = Window.orderBy("ratio", "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onwards = filling.rowsBetween(0, Window.unboundedFollowing)
    weight = _of_rank([F.lit(integral(k)) for k in schedules], F.col("rank"))
    rows = (sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight)
            .withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
            .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
            .withColumn("ratio", F.col("cap") / F.col("weight"))
            .withColumn("here", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                        / F.sum("weight").over(onwards)))
    # The level is that of the first source that isn't filled up.
    level = F.min(F.when(F.col("ratio") > F.col("here"), F.struct("ratio", "rank", "here"))).over(everything)
    return rows.withColumn("level", level["here"]).select(
        "source", "source_size", "rank",
        F.when(F.col("level").isNull(), F.col("cap"))
        .otherwise(F.least("cap", F.col("weight") * F.col("level"))).alias("target"))


def position(place: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """Training time at which a share ``place`` (0..1) of a source's demand has come up."""
    segments = _of_rank([_segments(k) for k in schedules], rank)
    wanted = place * _of_rank([F.lit(integral(k)) for k in schedules], rank)
    at = F.element_at(F.filter(segments, lambda s: (s["c0"] <= wanted)), -1)
    rest = F.greatest(F.lit(0.0), F.least(wanted - at["c0"], at["area"]))
    # Solves w0 * u + slope / 2 * u ** 2 = rest without dividing by the slope.
    root = F.sqrt(F.greatest(F.lit(0.0), at["w0"] * at["w0"] + F.lit(2.0) * at["slope"] * rest))
    return at["t0"] + F.when(rest > 0, F.lit(2.0) * rest / (at["w0"] + root)).otherwise(F.lit(0.0))


def demand(docs: DataFrame, schedules=SCHEDULES, share: float = TOTAL_SHARE,
           repeats: float = MOST_REPEATS, text: str = "text", id_col: str = "doc_id",
           source: str = "source") -> tuple[DataFrame, DataFrame]:
    """What the mix takes of every row: ``file, place, id, size, before, source_size, rank, target, whole, part, taken``.

    ``file, place`` name a row of the second frame returned, which has every row
    of ``docs`` as a struct ``given``. ``taken`` counts the words the mix takes
    from a row: whole passes over the source, and of the last pass the words up
    to the target, so a source's taken words differ from its target by less than
    one. A null or empty text has no words and is taken 0 times; null sources
    are one source, the last; rows of a source are ordered by a digest of id and
    text. Empty input gives no rows. Texts are read once; all else works on
    narrow rows.
    """
    docs, file, place = row_place(docs)
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"),
                            F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows = materialize(docs.select(
        file.alias("file"), place.alias("place"), F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        digest.alias("digest")), "mix-rows")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source; written once, as both the sums and the targets come from it.
    aims = materialize(targets(totals, schedules, share, repeats), "mix-targets").withColumnRenamed("source", "aim_source")
    placed = running_before(rows, ["source"], "digest", ["id", "size"], F.col("size"), "before", rows.count())
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target").cast("long")
                                        - F.col("whole") * F.col("source_size") - F.col("before")))
    found = (placed.join(aims, F.col("source").eqNullSafe(F.col("aim_source")))
             .withColumn("whole", whole.cast("long"))
             .withColumn("part", part.cast("long"))
             .withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
             .drop("aim_source", "source", "digest"))
    return found, docs.select(whole_row(docs).alias("given"), file.alias("file"), place.alias("place"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The training stream: a row of ``docs`` for every copy taken, in order of position.

    Copies are whole documents: one for every whole pass, and one more when the
    last pass takes at least half of the document's words. Documents without
    words are not taken. Columns of any name come through.
    """
    schedules = options.get("schedules", SCHEDULES)
    wanted, rows = demand(docs, **options)
    copies = F.col("whole") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    at = position((F.col("before") + F.col("copy") * F.col("source_size")) / F.col("target"), F.col("rank"), schedules)
    # Positions are made on narrow rows; a text meets all its copies' at once.
    places = (wanted.where("taken > 0").withColumn("copies", copies.cast("int")).where("copies > 0")
              .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
              .groupBy("file", "place").agg(F.collect_list(at).alias("at")))
    stream = rows.join(materialize(places, "mix-places"), ["file", "place"]).select("given", F.explode("at").alias("at"))
    # The sort's sampling job reads the shuffle before it again, not the documents.
    return stream.orderBy("at").select("given.*")


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document: sizes, its source's target, the words taken, and its training position."""
    wanted, _ = demand(docs.select("doc_id", "text", "source"))
    place = F.col("before") / F.col("target")
    out = wanted.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken",
                        F.when(F.col("taken") > 0, position(place, F.col("rank"))).alias("position"))
    return materialize(out, "mix").orderBy(F.col("position").asc_nulls_last(), "doc_id")
