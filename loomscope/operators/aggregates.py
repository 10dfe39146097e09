"""Aggregates of metric values: column aggregates, and DataFrame ones where several passes are needed."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomscope.functions.text import ngram_counts
from loomscope.operators.requests import numbered
from loomscope.session import written


def perplexity(ll: Column) -> Column:
    """Mean of exp, not exp of the mean."""
    return F.avg(F.exp(ll))


def weighted_mean(a: Column, b: Column) -> Column:
    return F.sum(a) / F.sum(b)


def weighted_perplexity(a: Column, b: Column) -> Column:
    return F.exp(-weighted_mean(a, b))


def bits_per_byte(a: Column, b: Column) -> Column:
    return -weighted_mean(a, b) / F.ln(F.lit(2.0))


def mean_stderr(x: Column) -> Column:
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def f1(gold: Column, predicted: Column) -> Column:
    """Binary F1 of the class 1; 0 if there is nothing to divide by."""
    hit, extra, missed = (F.count_if(c) for c in ((gold == 1) & (predicted == 1), (gold != 1) & (predicted == 1), (gold == 1) & (predicted != 1)))
    return F.coalesce(F.try_divide(2.0 * hit, 2 * hit + extra + missed), F.lit(0.0))


def matthews(pairs: DataFrame, keys: list[str], gold: str, predicted: str, times: Column | None = None) -> DataFrame:
    """Multiclass Matthews correlation ``mcc`` of each key, from the counts of class pairs; a row counts ``times`` times."""
    n = F.count("*") if times is None else F.sum(times)
    cells = pairs.groupBy(*keys, gold, predicted).agg(n.cast("double").alias("n"))
    rows = cells.groupBy(*keys, F.col(gold).alias("c")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    cols = cells.groupBy(*keys, F.col(predicted).alias("c")).agg(F.sum("n").alias("p"))
    both = rows.join(cols, [*keys, "c"], "full").na.fill(0.0, ["t", "hit", "p"])
    s = both.groupBy(*keys).agg(F.sum("hit").alias("c"), F.sum("t").alias("s"), F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") ** 2).alias("tt"), F.sum(F.col("p") ** 2).alias("pp"))
    root = F.sqrt((F.col("s") ** 2 - F.col("pp")) * (F.col("s") ** 2 - F.col("tt")))
    return s.select(*keys, F.coalesce(F.try_divide(F.col("c") * F.col("s") - F.col("tp"), root), F.lit(0.0)).alias("mcc"))


def middle_in_order(values: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The value at position n // 2 in the order of ``order`` (not of the values), for each key. No task sorts a whole key."""
    rows = values.select(F.struct(*keys).alias("_k"), F.struct(order).alias("_order"), F.col(value).alias("middle"))
    sizes = rows.groupBy(F.col("_k").alias("_of")).agg(F.floor(F.count("*") / 2).alias("_half"))
    ranked = numbered(rows, "_order", "_k", number="_i").join(sizes, F.col("_k").eqNullSafe(F.col("_of")))
    return ranked.where("_i = _half").select(*(F.col("_k")[k].alias(k) for k in keys), "middle")


def medians(values: DataFrame, keys: list[str], value: str, name: str = "median", steps: int = 1024) -> DataFrame:
    """``keys, name``: the exact median of each key (the mean of the middle two of an even number), nulls left out.

    Values are counted in ``steps`` equal steps between a key's least and largest; only those of the one or two steps that
    hold the middle are ranked, so that no task sorts a whole key.
    """
    rows = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    key = F.struct(*keys) if keys else F.lit(0)
    rows = rows.withColumn("_k", key)
    ends = rows.groupBy(F.col("_k").alias("_of")).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    part = F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    rows = rows.join(ends, F.col("_k").eqNullSafe(F.col("_of"))).withColumn("_step", F.least(F.floor(part * steps), F.lit(steps - 1)))
    counts = rows.groupBy("_k", "_n", "_step").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_k").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most steps rows
    counts = counts.withColumn("_before", before)
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    holds = lambda at: (at >= F.col("_before")) & (at < F.col("_before") + F.col("_c"))
    middle = counts.where(holds(low) | holds(high)).select(F.col("_k").alias("_mk"), F.col("_step").alias("_ms"), "_before")
    inner = rows.join(middle, F.col("_k").eqNullSafe(F.col("_mk")) & (F.col("_step") == F.col("_ms")))
    inner = inner.groupBy("_k", "_n", "_step", "_before", "_v").agg(F.count("*").alias("_c"))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy("_k", "_step").orderBy("_v"))
    inner = inner.withColumn("_upto", upto)
    at = lambda i: (i < F.col("_upto")) & (i >= F.col("_upto") - F.col("_c"))
    out = inner.groupBy("_k").agg(((F.max(F.when(at(low), F.col("_v"))) + F.max(F.when(at(high), F.col("_v")))) / 2).alias(name))
    return out.select(*(F.col("_k")[k].alias(k) for k in keys), name)


def all_correct(answers: DataFrame, keys: list[str], label: Column, predicted: Column) -> DataFrame:
    """The share of groups of ``keys`` in which every answer is right."""
    return _all_right(answers, keys, label, predicted).agg(F.avg("ok").alias("acc_all"))


def all_correct_stderr(answers: DataFrame, keys: list[str], label: Column, predicted: Column) -> DataFrame:
    """The standard error of :func:`all_correct`; the keys may be fewer (the question without its paragraph)."""
    return _all_right(answers, keys, label, predicted).agg(mean_stderr(F.col("ok")).alias("acc_all_stderr"))


def _all_right(answers: DataFrame, keys: list[str], label: Column, predicted: Column) -> DataFrame:
    return answers.groupBy(*keys).agg(F.every(label == predicted).cast("double").alias("ok"))


def pooled(results: Column) -> Column:
    """Mean, standard error and size of a group of tasks, folded in order.

    results: an array of structs ``ord, m, se, n``. The variance between a task and the tasks before it uses the
    mean before the task is merged.
    """
    start = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("v"), F.lit(0.0).alias("n"))

    def merge(a: Column, t: Column) -> Column:
        n, se = t["n"].cast("double"), F.coalesce(t["se"], F.lit(0.0))
        total = a["n"] + n
        within = F.coalesce(F.try_divide((a["n"] - 1) * a["v"] + (n - 1) * se**2, total - 1), F.lit(0.0))
        apart = F.coalesce(F.try_divide(a["n"] * n, total * (total - 1)), F.lit(0.0)) * (a["m"] - t["m"]) ** 2
        return F.struct(((a["m"] * a["n"] + t["m"] * n) / total).alias("m"), F.when(a["n"] == 0, se**2).otherwise(within + apart).alias("v"), total.alias("n"))

    return F.aggregate(F.array_sort(results), start, merge, lambda a: F.struct(a["m"].alias("mean"), F.sqrt(a["v"]).alias("stderr"), a["n"].alias("n")))


def _bleu(most: int = 4) -> Column:
    logs, half = F.lit(0.0), F.lit(1.0)
    for n in range(1, most + 1):
        hit, of = F.col(f"hits{n}"), F.col(f"p{n}")
        half = F.when(hit == 0, half / 2).otherwise(half)
        logs = logs + F.ln(F.when(hit == 0, half).otherwise(hit) / of) / most
    penalty = F.when(F.col("p1") >= F.col("r1"), 1.0).otherwise(F.exp(1 - F.col("r1") / F.col("p1")))
    return F.when((F.col("p1") > 0) & (F.col(f"p{most}") > 0), 100 * penalty * F.exp(logs)).otherwise(0.0)


def _chrf(orders: int = 6, beta: float = 2.0) -> Column:
    occurs = [(F.col(f"r{n}") > 0) & (F.col(f"p{n}") > 0) for n in range(1, orders + 1)]
    mean = lambda c: F.try_divide(sum((F.when(o, F.col(f"hits{n}") / F.col(f"{c}{n}")).otherwise(0.0) for n, o in enumerate(occurs, 1)), F.lit(0.0)), sum((o.cast("int") for o in occurs), F.lit(0)))
    precision, recall = mean("p"), mean("r")
    return 100 * F.coalesce(F.try_divide((1 + beta**2) * precision * recall, beta**2 * precision + recall), F.lit(0.0))


def row_grams(pairs: DataFrame, kept: list[str], reference: Column, predicted: Column, orders: int, characters: bool = False) -> DataFrame:
    """``kept`` and, for each order, the n-grams of a row: ``hits1, r1, p1`` and so on."""
    one = pairs.select(*kept, ngram_counts(reference, predicted, orders, characters).alias("x"))
    return one.select(*kept, *(F.col(f"x.{c}")[n].alias(f"{c}{n + 1}") for c in ("hits", "r", "p") for n in range(orders)))


def _row_edits(pairs: DataFrame, kept: list[str], reference: Column, predicted: Column) -> DataFrame:
    one = pairs.select(*kept, F.pandas_udf(edit_rate, "edits INT, ref_words INT")(reference, predicted).alias("x"))
    return one.select(*kept, "x.edits", "x.ref_words")


@dataclass(frozen=True)
class SummedMetric:
    """A metric that is a function of sums over all rows: ``rows(pairs, kept, gold, predicted)`` gives ``kept`` and what each row
    adds to the sums; ``value`` is the metric by the sums' names."""

    rows: Callable[[DataFrame, list[str], Column, Column], DataFrame]
    value: Callable[[], Column]


def _row_value(transform: Callable[[Column], Column]) -> Callable[[DataFrame, list[str], Column, Column], DataFrame]:
    return lambda pairs, kept, gold, predicted: pairs.where(predicted.isNotNull()).select(*kept, transform(predicted.cast("double")).alias("s"), F.lit(1.0).alias("w"))


def _row_hits(pairs: DataFrame, kept: list[str], gold: Column, predicted: Column) -> DataFrame:
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return pairs.select(*kept, one((gold == 1) & (predicted == 1)).alias("hit"), one((gold != 1) & (predicted == 1)).alias("extra"), one((gold == 1) & (predicted != 1)).alias("missed"))


#: Metrics whose standard errors come from resamples of their sums; ``mean`` and ``perplexity`` are of the predicted column alone.
SUMMED: dict[str, SummedMetric] = {
    "mean": SummedMetric(_row_value(lambda x: x), lambda: F.try_divide("s", "w")),
    "perplexity": SummedMetric(_row_value(F.exp), lambda: F.try_divide("s", "w")),
    "f1": SummedMetric(_row_hits, lambda: F.coalesce(F.try_divide(2.0 * F.col("hit"), 2 * F.col("hit") + F.col("extra") + F.col("missed")), F.lit(0.0))),
    "bleu": SummedMetric(lambda *x: row_grams(*x, 4), _bleu),
    "chrf": SummedMetric(lambda *x: row_grams(*x, 6, True), _chrf),
    "ter": SummedMetric(_row_edits, lambda: F.coalesce(F.try_divide("edits", "ref_words"), F.lit(0.0))),
}


def summed(metric: str, pairs: DataFrame, keys: list[str], gold: Column, predicted: Column) -> DataFrame:
    """``keys`` and the metric of :data:`SUMMED` under its name; only what rows add to the sums is shuffled."""
    how = SUMMED[metric]
    rows = how.rows(pairs, keys, gold, predicted)
    sums = rows.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns if c not in keys))
    return sums.select(*keys, how.value().alias(metric))


def corpus_bleu(pairs: DataFrame, keys: list[str], reference: Column, predicted: Column) -> DataFrame:
    """Corpus BLEU (0-100) of texts of words with blanks between: clipped n-gram counts summed over all rows, geometric mean, brevity penalty.

    An order without a match counts as a half, a quarter and so on of one match. n-grams are counted within their row; only counts are shuffled.
    """
    return summed("bleu", pairs, keys, reference, predicted)


def edit_rate(references: pd.Series, predicted: pd.Series) -> pd.DataFrame:
    """Word edits with block shifts (greedy), and reference words, of each pair."""

    def edits(a: list[str], b: list[str]) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def shifted(hyp: list[str], ref: list[str]) -> int:
        shifts, best = 0, edits(hyp, ref)
        while best > 0:
            found = None
            for i in range(len(hyp)):
                for j in range(i + 1, min(i + 10, len(hyp)) + 1):
                    block = hyp[i:j]
                    for k in range(len(ref) - len(block) + 1):
                        if ref[k : k + len(block)] != block or k == i:
                            continue
                        rest = hyp[:i] + hyp[j:]
                        moved = rest[:k] + block + rest[k:]
                        if (cost := edits(moved, ref)) < (found[0] if found else best - 1):
                            found = (cost, moved)
            if not found:
                break
            best, hyp, shifts = found[0], found[1], shifts + 1
        return best + shifts

    rows = [(shifted((p or "").split(), (r or "").split()), len((r or "").split())) for r, p in zip(references, predicted)]
    return pd.DataFrame(rows, columns=["edits", "ref_words"])


def corpus_ter(pairs: DataFrame, keys: list[str], reference: Column, predicted: Column) -> DataFrame:
    """Translation edit rate: edits over reference words, summed over all rows."""
    return summed("ter", pairs, keys, reference, predicted)


#: Rows that are drawn for all resamples at once.
DRAWN = 2000


def poisson_weights(keys: np.ndarray, iterations: int, seed: int = 0) -> np.ndarray:
    """Weights of rows (64-bit hashes of their keys) in resamples: a row a key, each weight from a Poisson distribution of mean 1.

    The weight is a function of key, resample and seed alone, so that it is the same whatever the partitions.
    """
    with np.errstate(over="ignore"):
        z = keys.view(np.uint64)[:, None] ^ (np.arange(1, iterations + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))[None, :]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    uniform = (z >> np.uint64(11)).astype(np.float64) / (1 << 53)
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
    return np.searchsorted(below, uniform, "right").astype(np.float64)


def bootstrap_summed_stderr(metric: str, pairs: DataFrame, keys: list[str], row: str, gold: Column, predicted: Column, iterations: int = 100, seed: int = 0) -> DataFrame:
    """``keys, stderr, resamples``: the standard error of a metric of :data:`SUMMED` over resamples of the rows.

    Each row has a Poisson weight for each resample (what resampling with replacement tends to), by its unique key ``row``. Tasks add up
    the weighted sums of a batch, one line a key and resample, so that a hot key is summed before it is shuffled. Of the
    ``keys`` there are few by nature; nulls in them are a key.
    """
    how = SUMMED[metric]
    rows = how.rows(pairs.withColumn("_row", F.xxhash64(row)).withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0).alias("one"))), ["_key", "_row"], gold, predicted)
    names = [c for c in rows.columns if c not in ("_key", "_row")]
    flat = rows.select(F.to_json("_key").alias("_of"), "_row", *(F.col(c).cast("double") for c in names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), DRAWN):
                batch = whole.iloc[start : start + DRAWN]
                weights = poisson_weights(batch["_row"].to_numpy(np.int64), iterations, seed)
                values = batch[names].to_numpy(np.float64)
                for of, at in batch.groupby("_of").indices.items():
                    yield pd.DataFrame(weights[at].T @ values[at], columns=names).assign(_of=of, resample=np.arange(iterations))[["_of", "resample", *names]]

    drawn = flat.mapInPandas(run, "_of STRING, resample INT, " + ", ".join(f"{c} DOUBLE" for c in names))
    sums = drawn.groupBy("_of", "resample").agg(*(F.sum(c).alias(c) for c in names))
    out = sums.select("_of", how.value().alias("stat")).groupBy("_of").agg(F.stddev_samp("stat").alias("stderr"), F.count("stat").alias("resamples"))
    schema = rows.schema["_key"].dataType
    return out.withColumn("_key", F.from_json("_of", schema)).select(*(F.col("_key")[k].alias(k) for k in keys), "stderr", "resamples")


def bootstrap_matthews_stderr(pairs: DataFrame, keys: list[str], gold: str, predicted: str, iterations: int = 100, seed: int = 0) -> DataFrame:
    """``keys, stderr, resamples``: the standard error of :func:`matthews`; cells of class pairs are resampled by their counts."""
    cells = pairs.groupBy(*keys, gold, predicted).agg(F.count("*").alias("_n")).withColumn("_cell", F.xxhash64(*keys, gold, predicted))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.iloc[[i] * iterations]
                draw = np.random.default_rng([seed, int(np.int64(batch["_cell"].iloc[i]).view(np.uint64))]).poisson(batch["_n"].iloc[i], iterations)
                yield one.assign(_resample=np.arange(iterations, dtype=np.int32), _n=draw.astype(np.int64))

    schema = T.StructType([*cells.schema.fields, T.StructField("_resample", T.IntegerType())])
    drawn = cells.mapInPandas(run, schema).where("_n > 0")
    stats = matthews(drawn, [*keys, "_resample"], gold, predicted, F.col("_n"))
    return stats.groupBy(*keys).agg(F.stddev_samp("mcc").alias("stderr"), F.count("mcc").alias("resamples"))


def bootstrap_mean_stderr(values: DataFrame, value: str, transform=lambda mean: mean, iterations: int = 1000, seed: int = 0) -> DataFrame:
    """Standard error of ``transform(mean)`` over resamples: of a mean, or of what is a function of one (a perplexity).

    Each value has a weight drawn from a Poisson distribution of mean 1 for each resample, seeded by the value, its number and the
    resample: what resampling with replacement tends to, and a sum of partial sums. Equal values are counted first and
    weighted together, so that no task or the driver holds all values; the number of values has no limit.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, iterations))
        for batch in batches:
            for v, n in zip(batch["v"].to_numpy(), batch["n"].to_numpy()):
                draw = np.random.default_rng([seed, int(n), int(np.float64(v).view(np.uint64))]).poisson(n, iterations)
                total += draw * np.array([[v], [1.0]])
        yield pd.DataFrame({"resample": np.arange(iterations), "s": total[0], "w": total[1]})

    sums = counts.mapInPandas(run, "resample INT, s DOUBLE, w DOUBLE").groupBy("resample").agg((F.sum("s") / F.sum("w")).alias("mean"))
    return sums.select(transform(F.col("mean")).alias("stat")).agg(F.stddev_samp("stat").alias("stderr"), F.count("stat").alias("resamples"))


def bootstrap_median_stderr(values: DataFrame, value: str, iterations: int = 1000) -> DataFrame:
    """Standard error of the upper median (position n // 2) over resamples with replacement, of any number of values.

    In a resample of n, the value at position k in order is that of ``values`` at position floor(n * V), where V, the
    k-th of n uniform numbers in order, has the distribution Beta(k + 1, n - k). So a seeded V is drawn for each
    resample and its value is looked up by the running counts of range-partitioned values: exactly the distribution
    of resampled medians, reproducible whatever the partitions.
    """
    spark = values.sparkSession
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    counts = written(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
    sizes = sorted((r.part, r.n) for r in counts.groupBy("part").agg(F.sum("n").alias("n")).collect())
    ends = np.cumsum([n for _, n in sizes])
    n = int(ends[-1]) if sizes else 0
    at = np.minimum((np.random.default_rng(0).beta(n // 2 + 1, n - n // 2, iterations) * n).astype(np.int64), n - 1) if n else []
    of = np.searchsorted(ends, at, "right") if n else []
    ranks = [(sizes[p][0], int(i - ends[p] + sizes[p][1])) for p, i in zip(of, at)]
    drawn = F.broadcast(spark.createDataFrame(ranks, "part INT, rank BIGINT"))
    running = counts.withColumn("end", F.sum("n").over(Window.partitionBy("part").orderBy("v")))
    stats = running.join(drawn, "part").where("rank < end AND rank >= end - n")
    return stats.agg(F.stddev_samp("v").alias("stderr"), F.count("*").alias("resamples"))
