"""Groups of records whose texts repeat each other with small edits, insertions or moved clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscope.functions.words import word_hashes
from loomscope.llm import sketches
from loomscope.session import table, written

#: Ids that may be sent to all tasks to keep unneeded word sets out of the verifying join (8 bytes each).
MOST_SENT_IDS = 1_000_000


def conversation_text(conversations: Column) -> Column:
    """All ``content`` of a record together, nulls left out."""
    return F.array_join(F.transform(conversations, lambda m: m["content"]), "\n")


def verified(docs: DataFrame, pairs: DataFrame, contained: str | None = None) -> DataFrame:
    """The ``pairs`` (``a, b``) whose word sets in ``docs`` (``id, toks, n``) are alike, by exact Jaccard similarity.

    contained: a column that is 0 for the one of a pair whose containment in the other has to reach the threshold first.
    """
    pairs = written(pairs.distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if 2 * pairs.count() <= MOST_SENT_IDS:
        docs = docs.join(F.broadcast(ids), "id", "left_semi")
    sets = docs.select("id", "toks", "n", (F.col(contained) if contained else F.lit(None)).alias("side"))
    both = pairs.join(sets.toDF("a", "toks_a", "n_a", "side_a"), "a").join(sets.drop("side").toDF("b", "toks_b", "n_b"), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("toks_a", "toks_b")))
    shared = F.col("shared")
    least, of = sketches.ALIKE
    if contained:
        both = both.where(of * shared >= least * F.when(F.col("side_a") == 0, F.col("n_a")).otherwise(F.col("n_b")))
    return both.where(of * shared >= least * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``id BIGINT, label BIGINT`` for each end of ``links`` (``a BIGINT, b BIGINT``): equal labels, same component.

    Each round maps every node to the least of itself and its neighbours and contracts the links by that map;
    stars collapse in one round, chains in a logarithmic number. No group is collected, minima are combined
    before the shuffle.
    """
    edges = links.where("a <> b").select("a", "b")
    labels = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        step = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "id"), "step")
        if labels is None:
            labels = step
        else:
            nxt = step.toDF("label", "to")
            labels = labels.join(nxt, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        edges = edges.join(step.toDF("a", "la"), "a").join(step.toDF("b", "lb"), "b").where("la <> lb")
        edges = written(edges.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return written(labels, "labels")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of alike texts: ``field_name STRING, group_key BIGINT, member_key BIGINT``.

    docs: ``field_name STRING, key BIGINT, text STRING``; fields are kept apart. Texts are alike if the words
    they share are at least 0.7 of all their words; alike texts, directly or through others, are a group. One
    row for each key of a group but the smallest, which is the group's key.

    Exact copies of a word set become one document first, so copies cost one row each however many there are.
    Its bottom-k sketch is listed under each retained value (see :mod:`loomscope.llm.sketches`), the lists
    generate pairs, the union-sketch bound filters them and the exact similarity verifies them. Entries of a
    long list first try the same few partners; only pairs that are not connected by then are tried afterwards, so
    no pair is lost and a large group never expands into all its pairs. Word sets are compared by the 57-bit hashes of
    their words and named by 64-bit hashes: "exact" is up to a collision of those.

    Null, empty and wordless texts and null keys belong to no group. A key that comes several times counts once
    (with different texts: it connects them). Ties have no influence. Other columns are ignored; an empty table
    gives an empty result.
    """
    docs = docs.select("field_name", "key", F.sort_array(word_hashes(F.col("text"), F.col("field_name"))).alias("toks"))
    docs = written(docs.where("key IS NOT NULL").withColumn("id", F.xxhash64("toks")), "texts")
    docs = docs.where("size(toks) > 0")  # not before: the words would be read twice
    members = docs.select("field_name", "key", "id")
    sets = sketches.ranked(docs.select("id", "toks").dropDuplicates(["id"]), sketches.word_classes(docs))
    sets = written(sets.withColumn("n", F.size("toks")), "sets")

    found = written(sketches.candidates(*sketches.entries(sets)), "candidates")
    keys = members.select("key", "field_name", "id").distinct()
    one_key = keys.groupBy("field_name", "key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b")
    same_key = keys.join(one_key, ["field_name", "key"]).where("id <> a").select("a", F.col("id").alias("b"))
    links = written(verified(sets, found.where("a IS NOT NULL").select("a", "b")).union(same_key), "links")
    labels = components(links)
    left = found.where("a IS NULL").select(*sketches.COLUMNS)
    if not left.isEmpty():
        more = written(verified(sets, sketches.candidates_left(left, labels)), "links")
        if not more.isEmpty():
            labels = components(links.union(more))
    named = keys.join(labels, "id", "left").select("field_name", "key", F.coalesce("label", "id").alias("label"))
    named = named.distinct()
    group = named.groupBy("label").agg(F.min("key").alias("group_key"), F.count("*").alias("size")).where("size > 1")
    return named.join(group, "label").where("key <> group_key").select("field_name", "group_key", F.col("key").alias("member_key")).distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups in ``func_records.func`` and ``train_samples.conversations``."""
    func = table(spark, sf_dir, "func_records").select(F.lit("func").alias("field_name"), F.col("rec_id").alias("key"), F.col("func").alias("text"))
    talk = table(spark, sf_dir, "train_samples").select(F.lit("conversations").alias("field_name"), F.col("sample_id").alias("key"), conversation_text(F.col("conversations")).alias("text"))
    return near_duplicates(func.union(talk))
