"""Answer normalisation and text metrics as column expressions."""

from __future__ import annotations

import re
import string
from itertools import chain

import numpy as np
import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F


def alnum(text: Column) -> Column:
    """Lower case, ASCII letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-zA-Z0-9]", "")


def stable_hash(key: Column, seed: int = 0) -> Column:
    """60 bits of the MD5 of seed and key: the same in every engine and release, unlike Spark's own hashes."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 15), 16, 10).cast("bigint")


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def char_set_f1(gold: Column, predicted: Column) -> Column:
    """F1 of the sets of characters of two normalised answers; 0 if one is empty."""
    a, b = (F.array_distinct(F.regexp_extract_all(alnum(x), F.lit("."), F.lit(0))) for x in (gold, predicted))
    return _f1(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def token_f1(gold: Column, predicted: Column) -> Column:
    """F1 of the distinct words of two answers."""
    a, b = (F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))) for x in (gold, predicted))
    return _f1(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def _f1(shared: Column, a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * shared, a + b), F.lit(0.0))


def anls(references: Column, predicted: Column, least: float = 0.5) -> Column:
    """Average normalised Levenshtein similarity to the closest of ``references``; below ``least`` it is 0."""
    tidy = lambda s: F.array_join(F.filter(F.split(F.lower(F.trim(s)), r"\s+"), lambda w: w != ""), " ")
    apart = F.transform(
        references, lambda r: F.coalesce(F.try_divide(F.levenshtein(tidy(r), tidy(predicted)), F.greatest(F.length(r), F.length(predicted))), F.lit(0.0))
    )
    score = 1 - F.array_min(apart)
    return F.when(score >= least, score).otherwise(0.0)


def matches(gold: Column, predicted: Column, ignore: list[str] = (), case: bool = False, punctuation: bool = False, numbers: bool = False) -> Column:
    """Exact match after the named differences are taken out (``case``, ``punctuation``, ``numbers``: ignored if true)."""
    out = []
    for x in (gold, predicted):
        for pattern in ignore:
            x = F.regexp_replace(x, pattern, "")
        x = F.lower(x) if case else x
        x = F.translate(x, string.punctuation, "") if punctuation else x
        out.append(F.translate(x, string.digits, "") if numbers else x)
    return out[0] == out[1]


def max_over_references(score, references: Column) -> Column:
    """The largest ``score(reference)`` of an array of references."""
    return F.array_max(F.transform(references, score))


def detokenised(text: Column) -> Column:
    """Spaces before punctuation and around apostrophes taken out."""
    for pattern, by in ((r" n't", "n't"), (r" \)", ")"), (r"\( ", "("), (r'" ', '"'), (r' "', '"'), (r" (['.,])", "$1")):
        text = F.regexp_replace(text, pattern, by)
    return text


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def ngrams(items: Column, n: int) -> Column:
    """Runs of ``n`` items joined by a blank."""
    count = F.greatest(F.size(items) - (n - 1), F.lit(0))
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(items, i, n), " "))


def sided_ngrams(items: Column, orders: range, side: str) -> Column:
    """All n-grams of several orders as structs ``n, g, side``."""
    tag = lambda n: lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"), F.lit(side).alias("side"))
    return F.flatten(F.array(*(F.transform(ngrams(items, n), tag(n)) for n in orders)))


def _hashed_runs(codes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` codes within a row, and the row of each."""
    count = max(len(codes) - n + 1, 0)
    inside = np.flatnonzero(row[:count] == row[n - 1 :]) if count else np.empty(0, np.int64)
    z = np.zeros(len(inside), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            z = (z ^ codes[inside + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            z ^= z >> np.uint64(31)
    return z.view(np.int64), row[inside]


def ngram_counts(reference: Column, predicted: Column, orders: int, characters: bool = False) -> Column:
    """``hits, r, p``: for the orders 1 to ``orders`` how many n-grams of two texts match (clipped), and how many each has.

    n-grams are of words between blanks or, with ``characters``, of characters without blanks; null counts as empty. A batch of rows is counted
    at once, n-grams as 64-bit hashes.
    """

    def run(reference: pd.Series, predicted: pd.Series) -> pd.DataFrame:
        size = len(reference)
        sides = [[list("".join(t.split())) if characters else t.split() for t in x.fillna("")] for x in (reference, predicted)]
        flat = list(chain.from_iterable(chain.from_iterable(sides)))
        codes = pd.factorize(np.array([*flat, ""], object))[0][:-1]
        lengths = [np.array([len(w) for w in side], np.int64) for side in sides]
        rows = [np.repeat(np.arange(size), n) for n in lengths]
        parts = (codes[: lengths[0].sum()], codes[lengths[0].sum() :])
        out = {k: np.zeros((size, orders), np.int64) for k in ("hits", "r", "p")}
        for n in range(1, orders + 1):
            counted = []
            for part, row, k in zip(parts, rows, "rp"):
                gram, of = _hashed_runs(part, row, n)
                out[k][:, n - 1] = np.bincount(of, minlength=size)
                order = np.lexsort((gram, of))
                gram, of = gram[order], of[order]
                first = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])]) if len(of) else np.empty(0, np.int64)
                counted.append(pd.DataFrame({"row": of[first], "gram": gram[first], "n": np.diff(np.r_[first, len(of)])}))
            both = counted[0].merge(counted[1], on=["row", "gram"])
            out["hits"][:, n - 1] = np.bincount(both["row"], np.minimum(both["n_x"], both["n_y"]), size)
        return pd.DataFrame({k: list(v) for k, v in out.items()})

    return F.pandas_udf(run, "hits ARRAY<BIGINT>, r ARRAY<BIGINT>, p ARRAY<BIGINT>")(reference, predicted)


#: The word splitting of machine translation evaluation named 13a, as patterns and what they become.
SPLIT_13A = (
    ("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "),
)


def tokenised_13a(text: Column) -> Column:
    """``text`` with blanks between its words and marks, as BLEU scores are compared on."""
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, by in SPLIT_13A:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(F.regexp_replace(text, " +", " "))


def escaped_split(text: Column, separator: str) -> Column:
    """``text`` split at every ``separator`` that has no backslash before it; of those that have one the backslash goes."""
    parts = F.split(text, r"(?<!\\)" + re.escape(separator), -1)
    return F.transform(parts, lambda p: F.replace(p, F.lit("\\" + separator), F.lit(separator)))


def argument_map(text: Column) -> Column:
    """``k=v,k=v`` as a map of names to the kind and the text of the value: bool, int, float or str."""
    parts = F.filter(F.split(F.trim(text), ","), lambda p: F.trim(p) != "")

    def kind(v: Column) -> Column:
        number = F.when(v.rlike(r"^[0-9]+$"), "int").when(v.try_cast("double").isNotNull(), "float")
        return F.struct(F.when(F.lower(v).isin("true", "false"), "bool").otherwise(F.coalesce(number, F.lit("str"))).alias("kind"), v.alias("value"))

    value = lambda p: F.trim(F.substring(p, F.locate("=", p) + 1, F.length(p)))
    entries = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), kind(value(p)).alias("value")))
    return F.map_from_entries(entries)
