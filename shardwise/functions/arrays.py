"""Array expressions for scores (JVM-side higher-order functions, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def to_double_array(col: Column | str) -> Column:
    return _c(col).cast("array<double>")


def log_sum_exp(col: Column | str) -> Column:
    """``log(sum(exp(x)))`` in one pass, kept stable by a running maximum.

    The state is the maximum so far and the sum of ``exp(x - maximum)``; a new
    maximum rescales the sum. One exponential per element. An array without
    elements, or with a null one, gives null.
    """
    low = F.lit(float("-inf"))

    def add(state: Column, x: Column) -> Column:
        up = F.struct(x.alias("top"), (state["total"] * F.exp(state["top"] - x) + 1.0).alias("total"))
        same = F.struct(state["top"].alias("top"), F.when(x == low, state["total"]).otherwise(
            state["total"] + F.exp(x - state["top"])).alias("total"))
        return F.when(x > state["top"], up).otherwise(same)

    start = F.struct(low.alias("top"), F.lit(0.0).alias("total"))
    return F.aggregate(to_double_array(col), start, add, lambda state: state["top"] + F.log(state["total"]))


def log_softmax(col: Column | str) -> Column:
    """``x - log(sum(exp(x)))`` for every element; the sum is taken once per array."""
    arr = to_double_array(col)
    # The lambda variable holds the sum, so it is not taken again for every element.
    return F.transform(F.array(log_sum_exp(arr)), lambda total: F.transform(arr, lambda x: x - total))[0]


def nll_of_scores(scores: Column | str, label: Column | str) -> Column:
    """Negative log-likelihood of a 0-based label under the log-softmax of ``scores``, without building it."""
    arr = to_double_array(scores)
    return log_sum_exp(arr) - F.element_at(arr, _c(label).cast("int") + F.lit(1))


def negative_log_likelihood(logp: Column | str, label: Column | str) -> Column:
    """``-logp[label]`` with a 0-based integer label."""
    return -F.element_at(_c(logp), _c(label).cast("int") + F.lit(1))
