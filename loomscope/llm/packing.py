"""Texts packed whole into containers of fixed capacity, neighbours on a space-filling curve together."""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscope.llm.tokens import TOKENIZER, token_place
from loomscope.session import spread, table, written

#: Items that are packed at once; containers with this much unused space stay open for the next ones.
WINDOW, OPEN_SPACE = 8192, 0.02
#: Open containers that are carried along the curve; beyond it the fullest are closed.
MOST_OPEN = 512
#: Plans that one call packs; the table of plans is small by nature and this is checked.
MOST_PLANS = 1000
#: Container ids of a partition start at its number times this.
PER_PARTITION = 1 << 40

PACKED = "plan_name STRING, container BIGINT, doc_id BIGINT, piece INT, from_token INT, n_tokens INT"


class _Packer:
    """Best fit over the open containers of one plan, which are kept in order of their free space."""

    def __init__(self, plan: str, capacity: int, first: int) -> None:
        self.plan, self.capacity, self.next = plan, capacity, first
        self.open: list[tuple[int, int]] = []

    def pack(self, sizes: np.ndarray) -> np.ndarray:
        """Containers of items, the largest items placed first; then containers that are nearly full are closed."""
        where = np.empty(len(sizes), np.int64)
        for i in np.argsort(-sizes, kind="stable"):
            size = int(sizes[i])
            at = bisect_left(self.open, (size, -1))
            if at < len(self.open):
                free, box = self.open.pop(at)
            else:
                free, box = self.capacity, self.next
                self.next += 1
            where[i] = box
            insort(self.open, (free - size, box))
        least = self.capacity * OPEN_SPACE
        self.open = [x for x in self.open if x[0] > least][-MOST_OPEN:]
        return where


def packed(docs: DataFrame, limits: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The container of each text, or piece of a text, for each plan: :data:`PACKED`.

    docs: ``doc_id BIGINT, text STRING``; limits: ``plan_name STRING, capacity_tokens INT`` (a few rows). Only a text of more
    tokens than the capacity is cut, into full containers and a rest. Texts are ordered along a Hilbert curve
    over their hashed and projected token vectors (range partitioned, ties and copies spread by ``doc_id``); each
    partition is walked in that order and neighbours are packed by best fit, the largest of a window first, into
    the containers still open. Only the open containers and one window are held.

    Null texts are left out; an empty text is an item of 0 tokens. Plans without a capacity above 0 give nothing.
    A repeated ``doc_id`` is placed as often as it comes. Other columns are ignored; empty tables give no rows.
    """
    placed = spread(docs.select("doc_id", "text")).where("text IS NOT NULL").select("doc_id", token_place("text", tokenizer).alias("p")).select("doc_id", "p.*")
    placed = written(placed, "places")
    plans = limits.where("capacity_tokens > 0").select("plan_name", "capacity_tokens").distinct().limit(MOST_PLANS + 1).collect()
    if len(plans) > MOST_PLANS:
        raise ValueError(f"more than {MOST_PLANS} plans")
    each = F.from_json(F.lit(json.dumps([p.asDict() for p in plans])), "ARRAY<STRUCT<plan_name: STRING, capacity_tokens: INT>>")
    items = placed.withColumn("plan", F.explode(each)).select("doc_id", "n_tokens", "curve", "plan.*")
    items = items.repartitionByRange("plan_name", "curve", "doc_id").sortWithinPartitions("plan_name", "curve", "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        packer, waiting = None, []
        following = TaskContext.get().partitionId() * PER_PARTITION

        def place(packer: _Packer, rows: pd.DataFrame) -> pd.DataFrame:
            capacity = packer.capacity
            size = rows["n_tokens"].to_numpy(np.int64)
            whole = size // capacity
            rest = size - whole * capacity
            part = (rest > 0) | (size == 0)
            count = whole + part
            row = np.repeat(np.arange(len(rows)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            full = piece < whole[row]
            box = np.empty(len(row), np.int64)
            box[full] = packer.next + np.arange(full.sum())
            packer.next += int(full.sum())
            box[~full] = packer.pack(rest[row[~full]])
            return pd.DataFrame(
                {
                    "plan_name": packer.plan,
                    "container": box,
                    "doc_id": rows["doc_id"].to_numpy()[row],
                    "piece": piece.astype(np.int32),
                    "from_token": (piece * capacity).astype(np.int32),
                    "n_tokens": np.where(full, capacity, rest[row]).astype(np.int32),
                }
            )

        for batch in batches:
            for (plan, capacity), rows in batch.groupby(["plan_name", "capacity_tokens"], sort=False):
                if packer is None or packer.plan != plan or packer.capacity != capacity:
                    if waiting:
                        yield place(packer, pd.concat(waiting))
                    following = packer.next if packer else following
                    packer, waiting = _Packer(plan, int(capacity), following), []
                waiting.append(rows)
                if sum(map(len, waiting)) >= WINDOW:
                    yield place(packer, pd.concat(waiting))
                    waiting = []
        if waiting:
            yield place(packer, pd.concat(waiting))

    return items.select("plan_name", "capacity_tokens", "curve", "doc_id", "n_tokens").mapInPandas(run, PACKED)


def container_fill(boxes: DataFrame, limits: DataFrame) -> DataFrame:
    """Tokens, items and fill of each container of :func:`packed`."""
    plans = limits.select("plan_name", "capacity_tokens").distinct()
    fill = boxes.groupBy("plan_name", "container").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("items"))
    return fill.join(F.broadcast(plans), "plan_name").withColumn("fill", F.round(F.col("tokens") / F.col("capacity_tokens"), 6))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def p5_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text of ``documents`` for every plan of ``pack_limits``."""
    return packed(_docs(spark, sf_dir), table(spark, sf_dir, "pack_limits"))


def p5_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fill of every container."""
    limits = table(spark, sf_dir, "pack_limits")
    return container_fill(packed(_docs(spark, sf_dir), limits), limits)


def p5_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused share of each plan."""
    by = p5_fill(spark, sf_dir).groupBy("plan_name", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return by.withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
