"""Sample-versus-population statistics.

One aggregation pass computes ``count, mean, stddev (sample), min, max`` for
every numeric column (optionally per group, one pass for all samples), then the
single result row per group is turned into a long table
``[group..., field, count, mean, stddev, min, max]``. z-scores compare a
sample's mean with a population's mean and standard deviation:
``(mean - mu) / (sigma / sqrt(n))`` where ``n`` is the largest count over the
sample's columns (or the column's own count with ``per_column_n``). The
population table has one row per column, so it is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_double, numeric_columns
from ..functions.rowindex import written
from ..functions.normal import two_sided_pvalue, two_sided_pvalue_udf

SUMMARY_ROWS = ("count", "mean", "stddev", "min", "max")


def _summary_aggs(cols: Sequence[str]) -> list:
    aggs = []
    for i, c in enumerate(cols):
        x = as_double(c)
        aggs += [
            F.count(x).alias(f"c{i}"),
            F.avg(x).alias(f"m{i}"),
            F.stddev_samp(x).alias(f"s{i}"),
            F.min(x).alias(f"lo{i}"),
            F.max(x).alias(f"hi{i}"),
        ]
    return aggs


def _to_long(grouped: DataFrame, keep: Sequence[str], cols: Sequence[str]) -> DataFrame:
    n = F.greatest(*[F.col(f"c{i}") for i in range(len(cols))]) if len(cols) > 1 else F.col("c0")
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("field"),
            F.col(f"c{i}").cast("long").alias("count"),
            F.col(f"m{i}").alias("mean"),
            F.col(f"s{i}").alias("stddev"),
            F.col(f"lo{i}").alias("min"),
            F.col(f"hi{i}").alias("max"),
        )
        for i, c in enumerate(cols)
    ])
    return grouped.select(*keep, n.cast("long").alias("sample_size"), F.inline(rows)).select(
        *keep, "field", "count", "mean", "stddev", "min", "max", "sample_size")


def summarize(df: DataFrame, columns: Sequence[str] | None = None,
              by: Sequence[str] | str | None = None) -> DataFrame:
    """Long summary: ``[by...], field, count, mean, stddev, min, max, sample_size``. [E1, E2]

    Text and boolean columns are left out unless named in ``columns``.
    ``sample_size`` is the largest count over the summarised columns of the group.
    """
    by = [by] if isinstance(by, str) else list(by or [])
    cols = list(columns) if columns is not None else numeric_columns(df, exclude=by, booleans=False)
    if not cols:
        raise ValueError("no numeric column to summarise")
    aggs = _summary_aggs(cols)
    grouped = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return _to_long(grouped, by, cols)


def combine_groups(long: DataFrame) -> DataFrame:
    """Whole-table summary per field from per-group summaries (no second scan). [E1]

    ``count`` adds up, ``mean`` is the count-weighted mean, the sum of squared
    deviations pools as ``sum(M2_g + n_g * (mean_g - mean)^2)`` with
    ``M2_g = stddev_g^2 * (n_g - 1)``, ``min``/``max`` combine directly. Two
    aggregations by field, each partial per task, so any number of groups is
    spread over all tasks; the per-field rows joined back are bounded by the
    number of columns and broadcast.
    """
    rows = long.where(F.col("count") > 0)
    first = rows.groupBy("field").agg(
        F.sum("count").alias("__n"),
        (F.sum(F.col("count") * F.col("mean")) / F.sum("count")).alias("__mu"),
        F.min("min").alias("__min"),
        F.max("max").alias("__max"),
    )
    m2 = (F.coalesce(F.col("stddev") * F.col("stddev") * (F.col("count") - F.lit(1)), F.lit(0.0))
          + F.col("count") * (F.col("mean") - F.col("__mu")) ** 2)
    spread = (rows.join(F.broadcast(first.select("field", "__mu")), "field")
              .groupBy("field").agg(F.sum(m2).alias("__m2")))
    return first.join(F.broadcast(spread), "field").select(
        "field",
        F.col("__n").cast("long").alias("count"),
        F.col("__mu").alias("mean"),
        F.when(F.col("__n") > 1, F.sqrt(F.col("__m2") / (F.col("__n") - F.lit(1)))).alias("stddev"),
        F.col("__min").alias("min"),
        F.col("__max").alias("max"),
    )


def wide_to_long(wide: DataFrame) -> DataFrame:
    """``field, count, mean, stddev, min, max`` from a ``summary`` + columns table. [E2, A9]"""
    fields = [c for c in wide.columns if c != "summary"]
    cells = wide.select("summary", *[as_double(c).alias(c) for c in fields]).unpivot(
        "summary", fields, "field", "value")
    rows = {k: F.max(F.when(F.col("summary") == k, F.col("value"))) for k in SUMMARY_ROWS}
    return cells.groupBy("field").agg(*[
        (F.coalesce(v, F.lit(0.0)).cast("long") if k == "count" else v).alias(k) for k, v in rows.items()])


def merge_summary(stored: DataFrame, added: DataFrame) -> DataFrame:
    """The wide summary of a population that ``added`` rows join, from its ``stored`` one. [A9, E1, E3]

    Only ``added`` is scanned: counts, means, squared deviations, least and
    greatest values of the two merge (see :func:`combine_groups`). A column that
    only one side has keeps that side's moments; one without values counts 0.
    No rows added: the stored summary.
    """
    known = [c for c in stored.columns if c != "summary"]
    new = numeric_columns(added, booleans=False)
    columns = known + [c for c in new if c not in known]
    rows = wide_to_long(stored) if known else None
    if new:
        fresh = summarize(added, new).drop("sample_size")
        rows = fresh if rows is None else rows.unionByName(fresh)
    if rows is None:
        raise ValueError("neither the stored summary nor the added rows have a numeric column")
    rows = written(rows, "moments")  # two rows per column, read twice
    merged = rows.select("field").distinct().join(combine_groups(rows), "field", "left").fillna({"count": 0})
    return long_to_wide(merged, SUMMARY_ROWS, columns)


def zscores_by_group(df: DataFrame, by: Sequence[str] | str, columns: Sequence[str] | None = None,
                     per_column_n: bool = False) -> DataFrame:
    """Every group of ``by`` as a sample of the whole table, from one scan. [E3, E7]

    Groups and whole table are grouping sets of one aggregation (partial per
    task, one exchange), written once; the whole table's row per field is joined
    back to the groups, so a table with millions of groups is handled by every task.
    """
    by = [by] if isinstance(by, str) else list(by)
    cols = list(columns) if columns is not None else numeric_columns(df, exclude=by, booleans=False)
    if not cols:
        raise ValueError("no numeric column to summarise")
    keys = [F.col(f"`{b}`") for b in by]
    grouped = df.groupingSets([keys, []], *keys).agg(F.grouping_id().alias("__whole"), *_summary_aggs(cols))
    # A row per group, written once, as it is read twice.
    long = _to_long(written(grouped, "group-summary"), [*by, "__whole"], cols)
    whole = long.where(F.col("__whole") != 0).select("field", "mean", "stddev")
    return zscores(long.where(F.col("__whole") == 0).drop("__whole"), whole, per_column_n=per_column_n)


def long_to_wide(long: DataFrame, rows: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``summary`` + one DOUBLE column per data column, rows in the order given. [E2, E6]"""
    melted = long.select("field", F.inline(F.array(*[
        F.struct(F.lit(k).alias("summary"), F.lit(i).alias("__o"), F.col(k).cast("double").alias("value"))
        for i, k in enumerate(rows)
    ])))
    return (
        melted.groupBy("summary", "__o").pivot("field", list(columns)).agg(F.first("value"))
        .orderBy("__o").drop("__o")
    )


def summary_wide(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``describe()``-shaped summary of the numeric columns, all values DOUBLE. [E1, E2]"""
    cols = list(columns) if columns is not None else numeric_columns(df, booleans=False)
    return long_to_wide(summarize(df, cols), SUMMARY_ROWS, cols)


def population_long(population: DataFrame) -> DataFrame:
    """``field, pop_mean, pop_stddev`` from a wide (``summary`` + columns) or long table. [E3]"""
    if "summary" in population.columns:
        values = [c for c in population.columns if c != "summary"]
        wide = population.select("summary", *[as_double(c).alias(c) for c in values])
        melted = wide.unpivot("summary", values, "field", "value")
        return melted.groupBy("field").agg(
            F.first(F.when(F.col("summary") == "mean", F.col("value")), ignorenulls=True).alias("pop_mean"),
            F.first(F.when(F.col("summary") == "stddev", F.col("value")), ignorenulls=True).alias("pop_stddev"),
        )
    return population.select(
        "field", F.col("mean").cast("double").alias("pop_mean"),
        F.col("stddev").cast("double").alias("pop_stddev"))


def zscores(sample: DataFrame, population: DataFrame, per_column_n: bool = False) -> DataFrame:
    """Add ``zscore`` to a long sample summary; columns missing from the population get null. [E3, E7]"""
    pop = population_long(population)
    n = F.col("count") if per_column_n else F.col("sample_size")
    # A constant population column (stddev 0) or an empty sample gives null, not an error.
    z = F.try_divide(F.col("mean") - F.col("pop_mean"),
                     F.try_divide(F.col("pop_stddev"), F.sqrt(n.cast("double"))))
    return sample.join(F.broadcast(pop), "field", "left").withColumn("zscore", z).drop(
        "pop_mean", "pop_stddev")


def pvalues(scored: DataFrame, use_udf: bool = False) -> DataFrame:
    """Add ``pvalue`` = two-sided normal tail of ``zscore`` (JVM ``erfc``; or the pandas UDF). [E4, H3]"""
    fn = two_sided_pvalue_udf if use_udf else two_sided_pvalue
    return scored.withColumn("pvalue", fn("zscore"))


def sample_vs_population(sample_df: DataFrame, population: DataFrame | None = None,
                         zscores_: bool = False, pvalues_: bool = False,
                         columns: Sequence[str] | None = None, per_column_n: bool = False,
                         wide: bool = True) -> DataFrame:
    """Summary of ``sample_df`` with optional ``zscores`` / ``pvalues`` against ``population``. [E1-E7]

    ``wide=True`` returns the reference's shape: rows ``count, mean, stddev,
    min, max[, zscores][, pvalues]`` and one DOUBLE column per numeric column.
    """
    if population is None and (zscores_ or pvalues_):
        raise ValueError("a population summary must be passed to compute zscores or pvalues")
    cols = list(columns) if columns is not None else numeric_columns(sample_df, booleans=False)
    long = summarize(sample_df, cols)
    rows = list(SUMMARY_ROWS)
    if population is not None and (zscores_ or pvalues_):
        long = zscores(long, population, per_column_n=per_column_n)
        if pvalues_:
            long = pvalues(long)
            rows.append("pvalue")
        if not zscores_:
            long = long.drop("zscore")
        else:
            rows.insert(len(SUMMARY_ROWS), "zscore")
    if not wide:
        return long
    renamed = long
    for src, dst in (("zscore", "zscores"), ("pvalue", "pvalues")):
        if src in rows:
            renamed = renamed.withColumnRenamed(src, dst)
    rows = [{"zscore": "zscores", "pvalue": "pvalues"}.get(r, r) for r in rows]
    return long_to_wide(renamed, rows, cols)
