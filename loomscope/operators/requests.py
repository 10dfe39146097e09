"""Requests: numbering, limits, shards, few-shot examples, templates, batches and the response cache."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomscope.functions.text import stable_hash
from loomscope.session import written


def numbered(docs: DataFrame, key: str, group: str | None = None, descending: bool = False, number: str = "doc_id") -> DataFrame:
    """``docs`` with ``doc_id``, the 0-based position in the order of the unique ``key``, or in that of each ``group``.

    The order is global but no task sees all rows, nor all of a group: rows are range partitioned and written with their
    partition, so that it stays the same, and the rows of the partitions before give each partition's start.
    """
    order = F.desc(key) if descending else F.asc(key)
    groups = [group] if group else []
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(docs.repartitionByRange(parts, *groups, order).withColumn("_part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_part", *groups).orderBy(order)
    counts = ranged.groupBy("_part", *groups).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = counts.select("_part", *(F.col(g).alias("_group") for g in groups), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    on = F.col("_part") == F.col("_of")
    if group:
        on = on & F.col(group).eqNullSafe(F.col("_group"))
    rows = ranged.withColumn("_in", F.row_number().over(w)).join(starts.withColumnRenamed("_part", "_of"), on)
    return rows.withColumn(number, F.col("_start") + F.col("_in") - 1).select(*docs.columns, number)


def limited(docs: DataFrame, limit: float) -> DataFrame:
    """The first ``limit`` documents by ``doc_id``; below 1 it is a share of all documents."""
    if limit >= 1:
        return docs.where(F.col("doc_id") < int(limit))
    total = docs.agg(F.count("*").alias("_total"))
    return docs.join(F.broadcast(total)).where(F.col("doc_id") < F.floor(F.col("_total") * limit)).drop("_total")  # one row


def selected(docs: DataFrame, indices: DataFrame) -> DataFrame:
    """The documents whose ``doc_id`` is in the table ``indices``."""
    return docs.join(indices.select("doc_id").distinct(), "doc_id", "left_semi")


def first(docs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` documents by ``doc_id``; fewer documents than that are an error."""
    if docs.where(F.col("doc_id") == n - 1).isEmpty():
        raise ValueError(f"fewer than {n} documents")
    return docs.where(F.col("doc_id") < n)


def shard(docs: DataFrame, rank: int, of: int) -> DataFrame:
    """Every ``of``-th document from ``rank`` on."""
    return docs.where(F.col("doc_id") % of == rank)


def repeated(docs: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times, numbered by ``repeat``."""
    return docs.withColumn("repeat", F.explode(F.sequence(F.lit(0), times - 1)))


def template(text: str) -> Column:
    """A text with ``{{column}}`` places as an expression; an unknown column fails when the query is analysed."""
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", text)
    return F.concat(*(F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def hashed_choice(key: Column, options: list[str]) -> Column:
    """One of a few options by the hash of a key."""
    return F.element_at(F.array(*(F.lit(o) for o in options)), (F.pmod(F.xxhash64(key), F.lit(len(options))) + 1).cast("int"))


def few_shot(docs: DataFrame, pool: DataFrame, k: int, group: str, key: str, text: Column, description: str = "", joined: str = "\n\n", delimiter: str = " ", target: Column | None = None, seed: int = 1234) -> DataFrame:
    """``docs`` with ``context``: a description, ``k`` examples of ``pool`` of the same ``group``, and the own text.

    An example is its text, the delimiter and its target, where one is given. Each document has its own draw: examples of a group are numbered in the
    order of their hash, and it takes the ``k`` behind the place that its own hash names (around the end), without itself. Each
    of the ``k + 1`` places is a join of its own, so that no list of a group is built; a smaller group gives what it has.
    """
    shown = F.concat(text, F.lit(delimiter), target) if target is not None else text
    items = pool.select(F.col(group).alias("_g"), F.col(key).alias("_key"), shown.alias("_text"), F.struct(stable_hash(F.col(key), seed).alias("h"), F.col(key).alias("k")).alias("_order"))
    items = written(numbered(items, "_order", "_g", number="_i").drop("_order"), "examples")
    sizes = items.groupBy("_g").agg(F.count("*").alias("_n"))
    rows = docs.join(sizes, F.col(group) == F.col("_g"), "left").drop("_g")
    place = F.transform(F.sequence(F.lit(0), F.least(F.lit(k + 1).cast("bigint"), F.col("_n")).cast("int") - 1), lambda j: F.pmod(stable_hash(F.col(key), seed + 1), F.col("_n")) + j)
    wanted = rows.where("_n > 0").select(F.col(key).alias("_doc"), F.col(group).alias("_of"), F.posexplode(F.transform(place, lambda i: i % F.col("_n"))).alias("_rank", "_at"))
    found = wanted.join(items, (F.col("_of") == F.col("_g")) & (F.col("_at") == F.col("_i"))).where("_key <> _doc")
    shots = found.groupBy("_doc").agg(F.slice(F.array_sort(F.collect_list(F.struct("_rank", "_text"))), 1, k).alias("_shots"))  # k + 1 items
    out = docs.join(shots, F.col(key) == F.col("_doc"), "left")
    own = F.transform(F.coalesce("_shots", F.array().cast("array<struct<_rank:int,_text:string>>")), lambda s: s["_text"])
    parts = [F.array(F.lit(description))] if description else []
    return out.withColumn("context", F.array_join(F.concat(*parts, own, F.array(text)), joined)).drop("_doc", "_shots")


#: What names a request: the task, its document, which of the document's requests, and which repeat of it.
REQUEST = ("task", "doc_id", "idx", "repeat")


def answered(requests: DataFrame, responses: DataFrame, response: str = "response") -> DataFrame:
    """``requests`` with the response to each, found by :data:`REQUEST` and not by position; null where there is none.

    A response that is delivered again counts once, the least of different ones.
    """
    return requests.join(responses.groupBy(*REQUEST).agg(F.min(response).alias(response)), list(REQUEST), "left")


def request_hash(method: str, *arguments: Column) -> Column:
    """SHA-256 of a request as a JSON list of method and arguments."""
    return F.sha2(F.concat(F.lit(f'["{method}"'), *(F.concat(F.lit(',"'), a, F.lit('"')) for a in arguments), F.lit("]")), 256)


def misses(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests that are not in the cache."""
    return requests.join(cache, key, "left_anti")


def filled(requests: DataFrame, cache: DataFrame, fresh: DataFrame, key: str, response: str = "response") -> DataFrame:
    """``requests`` with the response of the cache, or of ``fresh`` for those it misses."""
    known = cache.select(key, F.col(response).alias("_old")).dropDuplicates([key])
    new = fresh.select(key, F.col(response).alias("_new")).dropDuplicates([key])
    out = requests.join(known, key, "left").join(new, key, "left")
    return out.withColumn(response, F.coalesce("_old", "_new")).drop("_old", "_new")


def batches(requests: DataFrame, group: str, length: Column, size: int, key: str) -> DataFrame:
    """``requests`` with ``batch``: those of a group in order of falling length (ties by key), ``size`` to a batch."""
    rows = numbered(requests.withColumn("_order", F.struct((-length).alias("l"), F.col(key))), "_order", group, number="_i")
    return rows.withColumn("batch", F.floor(F.col("_i") / size)).drop("_order", "_i")


def near_equal(docs: DataFrame, group: str, parts: int, key: str) -> DataFrame:
    """``docs`` with ``part``: each group in contiguous parts, the first ones larger by one."""
    sizes = docs.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_n"))
    rows = numbered(docs, key, group, number="_i").join(sizes, F.col(group).eqNullSafe(F.col("_group")))
    least, more = F.floor(F.col("_n") / parts), F.col("_n") % parts
    edge = more * (least + 1)
    part = F.when(F.col("_i") < edge, F.floor(F.col("_i") / (least + 1))).otherwise(more + F.floor((F.col("_i") - edge) / F.greatest(least, F.lit(1))))
    return rows.withColumn("part", part + 1).drop("_i", "_n", "_group")


def resolved(spec: str, columns: list[str]) -> Column:
    """What a specification names: a column, else a template."""
    return F.col(spec) if spec in columns else template(spec)
