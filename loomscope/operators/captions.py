"""Corpus text metrics that count n-grams over all pairs: chrF, BLEU of captions, ROUGE-L and CIDEr."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscope.functions.text import sided_ngrams
from loomscope.operators.aggregates import row_grams, summed


def _gram_rows(pairs: DataFrame, keys: list[str], sides: dict[str, Column], orders: range) -> DataFrame:
    """``keys, n, g`` and, for each side, how often a row holds the n-gram."""
    grams = F.concat(*(sided_ngrams(items, orders, side) for side, items in sides.items()))
    rows = pairs.select(*keys, F.explode(grams).alias("x")).select(*keys, "x.n", F.xxhash64("x.g").alias("g"), "x.side")
    return rows.groupBy(*keys, "n", "g").agg(*(F.count_if(F.col("side") == s).alias(s) for s in sides))


def corpus_chrf(pairs: DataFrame, keys: list[str], reference: Column, predicted: Column) -> DataFrame:
    """chrF (0-100) of each key: precision and recall of character n-grams without blanks, each averaged over the orders that occur, as one F-beta.

    n-grams are counted within their row; only counts are shuffled.
    """
    return summed("chrf", pairs, keys, reference, predicted)


def caption_bleus(pairs: DataFrame, keys: list[str], reference: Column, predicted: Column, orders: int = 4) -> DataFrame:
    """``bleu_1`` to ``bleu_4`` (0-1) of captions: as corpus BLEU up to each order, where an order without a match leaves next to nothing."""
    rows = row_grams(pairs, keys, reference, predicted, orders)
    sums = rows.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns if c not in keys))
    ratio = (F.col("p1") + 1e-15) / (F.col("r1") + 1e-9)
    penalty = F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(1.0)
    logs, out = F.lit(0.0), []
    for n in range(1, orders + 1):
        logs = logs + F.ln((F.col(f"hits{n}") + 1e-15) / (F.col(f"p{n}") + 1e-9))
        out.append((penalty * F.exp(logs / n)).alias(f"bleu_{n}"))
    return sums.select(*keys, *out)


def rouge_l(reference: Column, predicted: Column, beta: float = 1.2) -> Column:
    """ROUGE-L of two texts: F of the longest common subsequence of words against both lengths; 0 if there is none."""
    x = F.pandas_udf(common_words, "lcs INT, r INT, p INT")(reference, predicted)
    precision, recall = F.try_divide(x["lcs"], x["p"]), F.try_divide(x["lcs"], x["r"])
    return F.coalesce(F.try_divide((1 + beta**2) * precision * recall, recall + beta**2 * precision), F.lit(0.0))


def common_words(reference: pd.Series, predicted: pd.Series) -> pd.DataFrame:
    """Length of the longest common subsequence of words of each pair, and both numbers of words.

    The state of a pair is one number with a bit a word of the reference, so that a word of the other text costs a few operations.
    """

    def one(r: list[str], p: list[str]) -> int:
        at: dict[str, int] = {}
        for i, w in enumerate(r):
            at[w] = at.get(w, 0) | 1 << i
        full = (1 << len(r)) - 1
        row = full
        for w in p:
            met = row & at.get(w, 0)
            row = ((row + met) | (row - met)) & full
        return len(r) - row.bit_count()

    split = [((r or "").split(), (p or "").split()) for r, p in zip(reference, predicted)]
    return pd.DataFrame([(one(r, p), len(r), len(p)) for r, p in split], columns=["lcs", "r", "p"])


def cider(pairs: DataFrame, row: str, reference: Column, predicted: Column, orders: int = 4, sigma: float = 6.0) -> DataFrame:
    """``row, cider`` of each pair: tf-idf cosine of word n-grams, clipped, with a penalty for other lengths, times 10.

    Document frequencies are those of the references of all pairs.
    """
    words = pairs.select(row, reference.alias("rw"), predicted.alias("pw"))
    counts = _gram_rows(words, [row], {"r": F.col("rw"), "p": F.col("pw")}, range(1, orders + 1))
    known = counts.where("r > 0").groupBy("n", "g").agg(F.count("*").alias("df"))
    total = words.agg(F.ln(F.count("*").cast("double")).alias("ln_docs"))
    idf = F.col("ln_docs") - F.ln(F.greatest(F.coalesce("df", F.lit(1)), F.lit(1)).cast("double"))
    vec = counts.join(known, ["n", "g"], "left").join(F.broadcast(total)).withColumn("idf", idf)  # total: one row
    vec = vec.withColumns({"vr": F.col("r") * F.col("idf"), "vp": F.col("p") * F.col("idf")})
    one = vec.groupBy(row, "n").agg(F.sum(F.least("vr", "vp") * F.col("vr")).alias("dot"), F.sqrt(F.sum(F.col("vr") ** 2)).alias("nr"), F.sqrt(F.sum(F.col("vp") ** 2)).alias("np"))
    sims = one.groupBy(row).agg(F.sum(F.coalesce(F.try_divide("dot", F.col("nr") * F.col("np")), F.lit(0.0))).alias("sim"))
    apart = (F.size("rw") - F.size("pw")).cast("double")
    penalty = F.exp(-(apart**2) / (2 * sigma**2))
    return words.join(sims, row, "left").select(row, (10 * F.coalesce("sim", F.lit(0.0)) / orders * penalty).alias("cider"))
