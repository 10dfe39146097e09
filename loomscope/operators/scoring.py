"""Scores of likelihood and generation requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def argmax(values: Column) -> Column:
    """0-based position of the largest value, the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def by_length(lls: Column, lengths: Column) -> Column:
    """Log likelihoods by the lengths of their choices; null for an empty choice."""
    return F.zip_with(lls, lengths, lambda l, n: F.try_divide(l, n))


def mutual_information(lls: Column, unconditional: Column) -> Column:
    return F.zip_with(lls, unconditional, lambda a, b: a - b)


def gold_index(gold: Column, choices: Column) -> Column:
    """The position of a gold answer given as text; -100 if it isn't a choice."""
    at = F.array_position(choices, gold)
    return F.when(at > 0, at - 1).otherwise(-100).cast("int")


def choice_requests(docs: DataFrame, keys: list[str], values: str) -> DataFrame:
    """A row for each choice of each document: ``keys, idx, value``."""
    return docs.select(*keys, F.posexplode(values).alias("idx", "value"))


def any_target(targets: Column, metric) -> Column:
    """1 if ``metric(target)`` is above 0 for one of several targets, else 0."""
    return F.exists(targets, lambda t: metric(t) > 0).cast("double")


def gold_indices(golds: Column, n_choices: Column) -> Column:
    """Gold answers given as positions; -100, which no choice has, for those out of range."""
    return F.transform(golds, lambda g: F.when((g >= 0) & (g < n_choices), g).otherwise(-100).cast("int"))


def in_gold(index: Column, golds: Column) -> Column:
    """1 if a chosen position is one of several gold ones, else 0."""
    return F.coalesce(F.array_contains(golds, index), F.lit(False)).cast("double")
