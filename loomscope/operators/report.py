"""Result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long(values: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """A row for each metric value: ``keys, metric, value``."""
    return values.unpivot(keys, metrics, "metric", "value").where("value IS NOT NULL")


def results(values: DataFrame) -> DataFrame:
    """``task, metric, filter, shown, stderr, n`` of long values; a mean of 0 to 1 is shown times 100, its standard error as it is."""
    out = values.groupBy("task", "metric").agg(F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("se"), F.count("value").alias("n"))
    return out.select("task", "metric", F.lit("none").alias("filter"), F.round(F.when(F.col("mean").between(0, 1), F.col("mean") * 100).otherwise(F.col("mean")), 4).alias("shown"), F.round("se", 4).alias("stderr"), "n")


def grouped(results_: DataFrame, groups: DataFrame) -> DataFrame:
    """Size-weighted mean of each metric and filter for the groups of ``groups`` (``group, task``); a task may be in several."""
    both = results_.join(groups, "task")
    return both.groupBy("group", "metric", "filter").agg((F.sum(F.col("shown") * F.col("n")) / F.sum("n")).alias("shown"), F.sum("n").alias("n"))


def result_rows(results_: DataFrame, versions: DataFrame) -> DataFrame:
    """The result table as it is shown: ``Tasks, Version, Filter, n_shot, Metric, Value, Sign, Stderr``.

    results_: of :func:`results`; versions: ``task, version, n_shot``. Numbers have four decimals; without a standard error there is
    no sign, a missing value is ``N/A``.
    """
    number = lambda c: F.coalesce(F.format_string("%.4f", F.col(c)), F.lit("N/A"))
    has = F.col("stderr").isNotNull() & F.col("shown").isNotNull()
    return results_.join(versions, "task", "left").select(
        F.col("task").alias("Tasks"), F.col("version").alias("Version"), F.col("filter").alias("Filter"), F.col("n_shot").cast("string").alias("n_shot"), F.col("metric").alias("Metric"),
        number("shown").alias("Value"), F.when(has, "±").otherwise("").alias("Sign"), F.when(has, number("stderr")).otherwise("").alias("Stderr"),
    )


def lines_of(text: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A metric that is a text of lines ``name: value`` as ``keys, metric, value``, a row a line."""
    line = text.select(*keys, F.explode(F.split(column, "\n")).alias("line")).where(F.col("line").contains(": "))
    return line.select(*keys, F.substring_index("line", ": ", 1).alias("metric"), F.substring_index("line", ": ", -1).alias("value"))


def hierarchy(members: DataFrame, most_depth: int = 16) -> DataFrame:
    """Groups and their tasks in the order they are shown: ``position, depth, name, shown`` (indented by depth).

    members: ``parent, name``, a parent null for what stands on top; a few rows by nature. Children follow their parent by name;
    a name below two groups is shown twice. A group that holds itself fails after ``most_depth`` levels.
    """
    level = members.where("parent IS NULL").select("name", F.array("name").alias("path"))
    found = [level]
    for _ in range(most_depth):
        level = members.join(level.select(F.col("name").alias("parent"), "path"), "parent").select("name", F.concat("path", F.array("name")).alias("path"))
        if level.isEmpty():
            break
        found.append(level)
    else:
        raise ValueError(f"groups deeper than {most_depth}")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    depth = F.size("path") - 1
    rows = out.select(depth.alias("depth"), "name", F.when(depth > 0, F.concat(F.repeat(F.lit(" "), depth), F.lit("- "), "name")).otherwise(F.col("name")).alias("shown"), "path")
    return rows.withColumn("position", F.row_number().over(Window.orderBy("path")) - 1).drop("path")  # a row a task


def sample_frame(answered: DataFrame, key: str, prompt: str, target: str, raw: str, filtered: str, metrics: list[str], kind: str = "generate_until") -> DataFrame:
    """One row a sample as trackers show it: ``id, data, input_len, labels, output_type, raw_predictions, filtered_predictions`` and the metrics."""
    return answered.select(
        F.col(key).cast("string").alias("id"), F.col(prompt).alias("data"), F.length(prompt).alias("input_len"), F.col(target).cast("string").alias("labels"), F.lit(kind).alias("output_type"),
        F.col(raw).alias("raw_predictions"), F.col(filtered).alias("filtered_predictions"), *metrics,
    )


def metric_name(column: Column) -> Column:
    """A result's key without the name of a filter that does nothing."""
    return F.regexp_replace(column, ",none$", "")


def split_key(column: Column) -> Column:
    """A key ``metric,filter`` as both; the filter is empty without a comma."""
    at = F.locate(",", column)
    return F.struct(F.when(at > 0, F.substring(column, F.lit(1), at - 1)).otherwise(column).alias("metric"), F.when(at > 0, F.substring(column, at + 1, F.length(column))).otherwise("").alias("filter"))


def markdown(results_: DataFrame, most: int = 100_000) -> str:
    """A result table (a row a task and metric) as a markdown table; more than ``most`` rows are an error."""
    head = ["task", "metric", "filter", "shown", "stderr", "n"]
    lines = ["|" + "|".join(head) + "|", "|" + "|".join(["---"] * len(head)) + "|"]
    rows = results_.orderBy("task", "metric").select(head).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} results")
    return "\n".join([*lines, *("|" + "|".join("N/A" if v is None else str(v) for v in r) + "|" for r in rows)])
