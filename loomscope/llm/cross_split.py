"""Records of evaluation splits that recur, exactly or nearly, in the training split."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscope.functions.words import word_hashes
from loomscope.llm import sketches
from loomscope.llm.near_duplicates import verified
from loomscope.session import table, written

#: Pictures are the same if their grey levels differ by at most this on average.
GREY_LEVELS = 10
#: Header of a grey netpbm picture: its parts are separated by white space and comment lines.
HEADER = re.compile(rb"P([25])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)")
PICTURE = "width INT, height INT, grey BINARY, aspect STRING, mark BIGINT"


def decode(image: bytes | None) -> np.ndarray | None:
    """Grey levels 0-255 of a binary (P5) or plain (P2) picture; None if it can't be read."""
    head = HEADER.match(image or b"")
    if not head:
        return None
    kind, width, height, most = (int(x) for x in head.groups())
    size, body = width * height, image[head.end() :]
    try:
        if kind == 5:
            grey = np.frombuffer(body[1:], ">u2" if most > 255 else np.uint8, size).astype(float)
        else:
            grey = np.array(re.sub(rb"#[^\n]*", b"", body).split()[:size], float)
        return np.rint(grey * 255 / most).astype(np.uint8).reshape(height, width) if size and most else None
    except ValueError:
        return None


def picture_mark(grey: np.ndarray) -> int:
    """The means of eight equal blocks in eight bytes; -1 if the sides can't be cut so. Blocks of similar pictures have similar means."""
    height, width = grey.shape
    down, across = (2, 4) if width >= height else (4, 2)
    if height % down or width % across:
        return -1
    means = grey.reshape(down, height // down, across, width // across).mean((1, 3)).ravel()
    return int(np.minimum(means, 254).astype(np.uint8).view(np.int64)[0])


def _pictures(image: pd.Series) -> pd.DataFrame:
    rows, known = [], {}
    for x in image:
        if x not in known:
            grey = decode(bytes(x)) if x is not None else None
            if grey is None:
                known[x] = (None, None, None, None, None)
            else:
                height, width = grey.shape
                part = math.gcd(width, height)
                known[x] = (width, height, grey.tobytes(), f"{width // part}:{height // part}", picture_mark(grey))
        rows.append(known[x])
    out = pd.DataFrame(rows, columns=["width", "height", "grey", "aspect", "mark"])
    return out.astype({"width": "Int32", "height": "Int32", "mark": "Int64"})


def _grey_apart(width_a: pd.Series, height_a: pd.Series, a: pd.Series, width_b: pd.Series, height_b: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for wa, ha, x, wb, hb, y in zip(width_a, height_a, a, width_b, height_b, b):
        if wa < wb:
            wa, ha, x, wb, hb, y = wb, hb, y, wa, ha, x
        x, y = (np.frombuffer(z, np.uint8).astype(float) for z in (x, y))
        if (wa, ha) == (2 * wb, 2 * hb):
            x = x.reshape(hb, 2, wb, 2).mean((1, 3)).ravel()
        elif (wa, ha) != (wb, hb):
            out.append(None)
            continue
        out.append(float(np.abs(x - y).mean()))
    return pd.Series(out, dtype=float)


def cross_split_overlaps(records: DataFrame) -> DataFrame:
    """Pairs of an evaluation record and a training record that are the same or nearly so.

    records: ``rec_id BIGINT, split STRING, func STRING, image BINARY`` (a record that comes again counts once). Result:
    ``eval_id, train_id, split`` (of the evaluation record), ``containment`` (share of the evaluation record's
    words that the training record holds), ``similarity`` (Jaccard, 0.7 or more), ``grey_apart`` (mean difference
    of the grey levels, 10 or less; a picture twice as large in both directions is brought to the smaller size).

    Copies become one class for each side first. The hashes of n-grams of words (one word, or two or three of them
    where one is frequent; the words of a set have no order but that of their hashes) of both sides are partitioned by hash; the training entries of
    a partition are scanned for hits of the evaluation entries (see :mod:`loomscope.llm.sketches`), where eight block means of
    the pictures already rule out most pairs of different pictures. A hit counts if the training record contains enough of the
    evaluation record's words, and is then verified exactly, words first, then pixels.

    Null or wordless ``func``, null or unreadable ``image``, null ``rec_id`` or ``split`` take part in no pair.
    Splits other than train are evaluation splits. Other columns are ignored; an empty table gives no rows.
    """
    picture = F.pandas_udf(_pictures, PICTURE)
    rows = records.where("rec_id IS NOT NULL AND split IS NOT NULL AND func IS NOT NULL AND image IS NOT NULL")
    rows = rows.select("rec_id", "split", F.col("split").eqNullSafe("train").cast("int").alias("side"), F.col("func"), picture("image").alias("p"))
    rows = rows.where("p.grey IS NOT NULL").select("rec_id", "split", "side", "p.*", F.sort_array(word_hashes(F.col("func"), F.col("p.aspect"))).alias("toks"))
    rows = rows.withColumn("id", F.xxhash64("toks", "grey", "width", "side"))
    rows = written(rows.dropDuplicates(["rec_id"]), "records").where("size(toks) > 0")  # not before: the words would be read twice
    members = rows.select("rec_id", "split", "id")
    classes = rows.drop("rec_id", "split").dropDuplicates(["id"])
    classes = written(sketches.ranked(classes, sketches.word_classes(classes)).withColumn("n", F.size("toks")), "classes")

    hits = sketches.candidates(*sketches.entries(classes), mark_apart=GREY_LEVELS)
    hits = hits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = verified(classes, hits, contained="side")
    sets = classes.select("id", "toks", "n", "width", "height", "grey", "side")
    one, other = ([F.col(c).alias(f"{c}_{x}") for c in sets.columns] for x in "ab")
    pairs = pairs.join(sets.select(*one).withColumnRenamed("id_a", "a"), "a").join(sets.select(*other).withColumnRenamed("id_b", "b"), "b")
    apart = F.pandas_udf(_grey_apart, "double")
    pairs = pairs.withColumn("grey_apart", apart("width_a", "height_a", "grey_a", "width_b", "height_b", "grey_b")).where(F.col("grey_apart") <= GREY_LEVELS)
    shared = F.size(F.array_intersect("toks_a", "toks_b"))
    a_eval = F.col("side_a") == 0
    pairs = pairs.select(
        F.when(a_eval, F.col("a")).otherwise(F.col("b")).alias("eval_class"),
        F.when(a_eval, F.col("b")).otherwise(F.col("a")).alias("train_class"),
        (shared / F.when(a_eval, F.col("n_a")).otherwise(F.col("n_b"))).alias("containment"),
        (shared / (F.col("n_a") + F.col("n_b") - shared)).alias("similarity"),
        "grey_apart",
    )
    evals = members.select(F.col("rec_id").alias("eval_id"), "split", F.col("id").alias("eval_class"))
    train = members.select(F.col("rec_id").alias("train_id"), F.col("id").alias("train_class"))
    pairs = pairs.join(evals, "eval_class").join(train, "train_class")
    return pairs.select("eval_id", "train_id", "split", "containment", "similarity", "grey_apart")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "func_records").select("rec_id", "split", "func", "image")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a test or val record and a train record of ``func_records`` that are the same or nearly so."""
    found = cross_split_overlaps(_records(spark, sf_dir))
    return found.select(F.least("eval_id", "train_id").alias("rec_a"), F.greatest("eval_id", "train_id").alias("rec_b"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records with an overlap, and overlapping pairs, by evaluation split and source."""
    found = cross_split_overlaps(_records(spark, sf_dir))
    source = table(spark, sf_dir, "func_records").groupBy(F.col("rec_id").alias("eval_id")).agg(F.min("source").alias("source"))
    found = found.join(source, "eval_id").groupBy("split", "source", "eval_id").agg(F.count("*").alias("pairs"), F.max("containment").alias("most"))
    return found.groupBy("split", "source").agg(
        F.count("*").alias("eval_records"), F.sum("pairs").alias("pairs"), F.round(F.avg("most"), 6).alias("mean_containment")
    )
