"""Histories of episodes and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_history(steps: DataFrame, trace: str, order: str, columns: list[str], last: int | None = None, names: str = "prev_{}") -> DataFrame:
    """``steps`` with an array ``prev_<c>`` of each column over the earlier steps of the trace (only the ``last`` ones if given)."""
    start = Window.unboundedPreceding if last is None else -last
    w = Window.partitionBy(trace).orderBy(order).rowsBetween(start, -1)
    # Nulls stay in the history, which collect_list alone would drop.
    member = lambda c: lambda x: x[c]
    return steps.withColumns({names.format(c): F.transform(F.collect_list(F.struct(c)).over(w), member(c)) for c in columns})


def numbered_steps(steps: DataFrame, trace: str, order: str) -> DataFrame:
    """``steps`` with ``step_no``, 0-based in each trace."""
    return steps.withColumn("step_no", F.row_number().over(Window.partitionBy(trace).orderBy(order)) - 1)


def following(steps: DataFrame, trace: str, order: str, column: str, name: str) -> DataFrame:
    """``steps`` with the value of the next step of the trace."""
    return steps.withColumn(name, F.lead(column).over(Window.partitionBy(trace).orderBy(order)))


def within_budget(turns: DataFrame, trace: str, order: str, length: Column, budget: int) -> DataFrame:
    """The newest turns of each trace whose lengths together stay within a budget, up to the first that doesn't."""
    w = Window.partitionBy(trace).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("_sum", F.sum(length).over(w)).where(F.col("_sum") < budget).drop("_sum")


def rolling_windows(tokens: Column, most: int, context: int) -> Column:
    """Windows over a token array: the first predicts up to ``most`` tokens, each later one ``most - context + 1`` more.

    Each is ``start, stop`` of the predicted tokens and ``from``, where its context begins.
    """
    n, step = F.size(tokens), most - context + 1
    first = F.struct(F.lit(0).alias("start"), F.least(n, F.lit(most)).alias("stop"), F.lit(0).alias("from"))
    count = F.ceil((n - most) / step).cast("int")
    ks = F.when(n > most, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    stop = lambda k: F.least(n, F.lit(most) + (k + 1) * step)
    later = F.transform(ks, lambda k: F.struct((F.lit(most) + k * step).alias("start"), stop(k).alias("stop"), F.greatest(stop(k) - most - 1, F.lit(0)).alias("from")))
    return F.when(n > 0, F.concat(F.array(first), later)).otherwise(F.slice(F.array(first), 1, 0))
