"""Declarative evaluation tasks: what a document is asked, how its response is filtered and scored, and how scores are summed."""

from __future__ import annotations

import fnmatch
import functools
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscope.operators import aggregates, curate, filters, report, requests
from loomscope.session import written

Metric = Callable[[DataFrame], Column]
METRICS: dict[str, Metric] = {}
AGGREGATIONS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "median": lambda x: F.percentile_approx(x, 0.5, 100_000),  # a sketch; aggregates.medians is exact
    "sum": F.sum,
    "perplexity": lambda x: F.avg(F.exp(x)),
}
#: Aggregations with a closed-form standard error, and those whose standard error comes from resamples (of ``values, column, row, iterations``); others have none.
STDERR: dict[str, Callable[[Column], Column]] = {"mean": lambda x: F.stddev_samp(x) / F.sqrt(F.count(x))}
RESAMPLED: dict[str, Callable[[DataFrame, str, str, int], DataFrame]] = {
    "median": lambda df, x, row, n: aggregates.bootstrap_median_stderr(df, x, n),
    "perplexity": lambda df, x, row, n: aggregates.bootstrap_summed_stderr("perplexity", df, [], row, F.lit(None), F.col(x), n),
}
TASKS: dict[str, Task] = {}
GROUPS: dict[str, list[str]] = {}


@dataclass(frozen=True)
class Task:
    """An evaluation task over a table of documents joined with responses (``resps ARRAY<STRING>``).

    ``doc_to_text`` and ``doc_to_target`` name a column or are templates. ``filters`` are the steps of its one pipeline; with ``pipelines``,
    steps by names, each of these is scored by itself. ``metrics`` maps a registered metric to the aggregation of its values.
    """

    name: str
    doc_to_text: str
    doc_to_target: str = ""
    where: str = "true"
    process_docs: Callable[[DataFrame], DataFrame] | None = None
    filters: tuple[tuple[str, dict], ...] = (("take_first", {}),)
    metrics: dict[str, str] = field(default_factory=dict)
    repeats: int = 1
    pipelines: dict[str, tuple[tuple[str, dict], ...]] = field(default_factory=dict)

    def extended(self, **changes) -> Task:
        """A copy with other fields, as a configuration that includes another."""
        return replace(self, **changes)


def metric(name: str) -> Callable[[Metric], Metric]:
    def put(f: Metric) -> Metric:
        METRICS[name] = f
        return f

    return put


def register(task: Task, group: str | None = None) -> Task:
    TASKS[task.name] = task
    if group and task.name not in GROUPS.setdefault(group, []):
        GROUPS[group].append(task.name)
    return task


def matching(patterns: list[str]) -> list[str]:
    """Names of tasks and groups that match shell patterns, sorted, each once."""
    return sorted({n for n in [*TASKS, *GROUPS] if any(fnmatch.fnmatch(n, p) for p in patterns)})


def requests_of(task: Task, docs: DataFrame) -> DataFrame:
    """The documents of a task with their ``prompt`` and ``target``, once for each repeat."""
    if task.process_docs:
        docs = docs.transform(task.process_docs)
    docs = docs.where(task.where).withColumn("prompt", requests.resolved(task.doc_to_text, docs.columns))
    if task.doc_to_target:
        docs = docs.withColumn("target", requests.resolved(task.doc_to_target, docs.columns))
    return requests.repeated(docs, F.lit(task.repeats))


def documents_of(docs: dict[str, DataFrame]) -> DataFrame:
    """The documents of several tasks as one table with ``group`` and ``task``; a task in several groups comes once for each, one in none with a null group."""
    frames = []
    for name, one in docs.items():
        frames += [one.withColumns({"group": F.lit(g).cast("string"), "task": F.lit(name)}) for g in [g for g, members in GROUPS.items() if name in members] or [None]]
    return curate.union(*frames)


def scores(task: Task, answered: DataFrame, steps: tuple[tuple[str, dict], ...] | None = None) -> DataFrame:
    """``answered`` (documents with ``resps``) with ``response``, the filtered one, and a column for each metric."""
    out = answered.withColumn("response", filters.pipeline(list(steps or task.filters))(F.col("resps")))
    return out.withColumns({m: METRICS[m](out).cast("double") for m in task.metrics})


def evaluate(task: Task, answered: DataFrame, row: str | None = None, iterations: int = 100) -> DataFrame:
    """``task, metric, filter, shown, stderr, n`` of a task: one pass over its answers for all metrics and pipelines.

    With ``row``, a unique key of the answers, aggregations of :data:`RESAMPLED` get their standard errors from resamples, in passes of their own.
    """
    pipelines = task.pipelines or {"none": task.filters}
    s, of = answered, []
    for i, (name, steps) in enumerate(pipelines.items()):
        one = scores(task, s, steps)
        of += [(name, m, how, f"_{i}_{m}") for m, how in task.metrics.items()]
        s = one.withColumns({f"_{i}_{m}": F.col(m) for m in task.metrics}).drop("response", *task.metrics)
    none = F.lit(None).cast("double")
    each = lambda name, m, how, c: F.struct(F.lit(name).alias("filter"), F.lit(m).alias("metric"), AGGREGATIONS[how](F.col(c)).alias("shown"), (STDERR[how](F.col(c)) if how in STDERR else none).alias("stderr"), F.count(c).alias("n"))
    rows = s.agg(F.array(*(each(*x) for x in of)).alias("all")).select(F.explode("all").alias("x"))
    out = rows.select(F.lit(task.name).alias("task"), "x.metric", "x.filter", "x.shown", "x.stderr", "x.n")
    drawn = [RESAMPLED[how](s, c, row, iterations).select(F.lit(name).alias("filter"), F.lit(m).alias("metric"), F.col("stderr").alias("_drawn")) for name, m, how, c in of if row and how in RESAMPLED]
    if not drawn:
        return out
    drawn = functools.reduce(DataFrame.union, drawn)  # a row a metric
    return out.join(drawn, ["metric", "filter"], "left").select("task", "metric", "filter", "shown", F.coalesce("stderr", "_drawn").alias("stderr"), "n")


def evaluate_all(patterns: list[str], answered: dict[str, DataFrame]) -> DataFrame:
    """The results of all matching tasks that have answers, then the weighted means of their groups."""
    names = [n for p in matching(patterns) for n in GROUPS.get(p, [p])]
    results = functools.reduce(DataFrame.union, [evaluate(TASKS[n], answered[n]) for n in dict.fromkeys(names) if n in answered])
    results = written(results, "results")  # a row a task and metric
    return results.unionByName(pooled_groups(results, GROUPS))


def pooled_groups(results: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """The size-weighted means of each group's tasks, as rows of a result table."""
    bridge = results.sparkSession.createDataFrame([(g, t) for g, ts in groups.items() for t in ts], "group STRING, task STRING")
    pooled = report.grouped(results, bridge)
    return pooled.select(F.col("group").alias("task"), "metric", "filter", "shown", F.lit(None).cast("double").alias("stderr"), "n")
