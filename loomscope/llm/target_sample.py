"""A sample whose category shares follow given targets: controlled rounding, then exact random-key quotas."""

from __future__ import annotations

import math
from collections import defaultdict, deque
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomscope.session import table

#: Rows of the target table that the driver rounds at once; the table is small by nature and this is checked.
MOST_CATEGORIES = 100_000
#: Leading bits of the random keys by which those of a category are counted; only keys that share the bits of the last one drawn are ranked.
PREFIX_BITS = 12
SAMPLE_PART = Decimal("0.05")

PLAN = (
    "device STRING, elem_tag STRING, target_share DOUBLE, min_count INT, available BIGINT, quota BIGINT, "
    "wanted DOUBLE, rounded BIGINT, taken BIGINT, short BIGINT, overrun BIGINT"
)


def _flow(edges: dict[tuple, int], source: object, sink: object) -> dict[tuple, int]:
    """A maximum flow (shortest augmenting paths) over ``edges`` (``(from, to): capacity``)."""
    left: dict = defaultdict(lambda: defaultdict(int))
    for (u, v), c in edges.items():
        left[u][v] += c
        left[v][u] += 0
    while True:
        before, queue = {source: None}, deque([source])
        while queue and sink not in before:
            u = queue.popleft()
            for v, c in left[u].items():
                if c > 0 and v not in before:
                    before[v] = u
                    queue.append(v)
        if sink not in before:
            return {(u, v): c - left[u][v] for (u, v), c in edges.items()}
        path, v = [], sink
        while before[v] is not None:
            path.append((before[v], v))
            v = before[v]
        step = min(left[u][v] for u, v in path)
        for u, v in path:
            left[u][v] -= step
            left[v][u] += step


def controlled_rounding(cells: dict[tuple, Decimal]) -> dict[tuple, int]:
    """The fractional two-way table ``cells`` (``(row, column): value``) made integer.

    Each cell, each row sum, each column sum and the total become one of their two neighbouring integers; an
    integer stays. A maximum flow with lower bounds finds such a table, and one always exists because the
    fractional table itself is a flow.
    """
    rows, columns = defaultdict(Decimal), defaultdict(Decimal)
    for (r, c), x in cells.items():
        rows[r] += x
        columns[c] += x
    total = sum(cells.values(), Decimal(0))
    bounds = {(("row", r), ("col", c)): x for (r, c), x in cells.items()}
    bounds |= {("in", ("row", r)): x for r, x in rows.items()} | {(("col", c), "out"): x for c, x in columns.items()}
    bounds[("out", "in")] = total
    # Lower bounds as usual: what must flow goes over a second source and sink.
    edges: dict = defaultdict(int)
    for (u, v), x in bounds.items():
        low, high = math.floor(x), math.ceil(x)
        edges[(u, v)] += high - low
        edges[("need", v)] += low
        edges[(u, "have")] += low
    flow = _flow(edges, "need", "have")
    return {(r, c): math.floor(x) + flow[(("row", r), ("col", c))] for (r, c), x in cells.items()}


def _wanted(share: dict[tuple, Decimal], least: dict[tuple, int], most: dict[tuple, int], size: int) -> dict[tuple, Decimal]:
    """Fractional quotas that fill ``size``: by share, but at least the minimum and at most what there is.

    What a category lacks goes to the others by their shares. Where the minima alone exceed ``size`` they are the quotas, and where all
    categories together are smaller, everything is.
    """
    low = {k: Decimal(min(least[k], most[k])) for k in share}
    out = {k: Decimal(most[k]) for k in share}
    if sum(low.values()) >= size:
        return low
    if sum(out.values()) <= size:
        return out
    scale = lambda s: {k: min(max(share[k] * s, low[k]), out[k]) for k in share}
    below, above = Decimal(0), Decimal(size)
    while sum(scale(above).values()) < size and above < Decimal(size) * 10**18:
        above *= 2
    for _ in range(120):
        middle = (below + above) / 2
        below, above = (middle, above) if sum(scale(middle).values()) < size else (below, middle)
    found = scale(above)
    free = [k for k in share if low[k] < found[k] < out[k]]
    rest = size - sum(x for k, x in found.items() if k not in free)
    shares = sum(share[k] for k in free)
    if not free or not shares:
        return found
    return found | {k: min(max(share[k] * rest / shares, low[k]), out[k]) for k in free}


def _name(c: str) -> Column:
    return F.lower(F.trim(c))


def target_plan(records: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each category of ``targets`` (:data:`PLAN`): what is there, its quota, and what a sample takes.

    records: ``rec_id, device, elem_tag``; a record counts once however often it comes. targets: ``device,
    elem_tag, target_share, min_count``. The sample has 5 % of the distinct records, rounded down. ``quota`` is
    the share of that in exact decimals, rounded up, or the minimum if that is larger; ``wanted`` the fractional
    quotas that fill the sample exactly, keep every minimum and take no more than is ``available`` (what one category
    lacks, the others give by their shares); ``rounded`` these made integer by controlled rounding over the table of
    devices and tags, which is what is ``taken``; ``short`` is what is missing to ``quota``. Where the minima alone exceed the
    sample they are drawn nevertheless, and ``overrun`` says by how many records in all. Device and tag compare trimmed and in lower case.

    Null device or tag matches nothing (such a target has nothing available), a null share or minimum is 0, a
    repeated category is one with the sum of the shares and the largest minimum. Empty records leave every
    target short; empty targets give an empty result. Other columns are ignored.
    """
    spark = records.sparkSession
    want = targets.groupBy("device", "elem_tag").agg(
        F.sum(F.coalesce("target_share", F.lit(0.0)).cast("decimal(28,12)")).alias("share"),
        F.max(F.coalesce("min_count", F.lit(0))).alias("least"),
    )
    want = [r.asDict() for r in want.limit(MOST_CATEGORIES + 1).collect()]
    if len(want) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} target categories")
    keyed = records.select("rec_id", _name("device").alias("d"), _name("elem_tag").alias("t")).where("rec_id IS NOT NULL").distinct()
    size = int(records.select("rec_id").distinct().count() * SAMPLE_PART)
    names = spark.createDataFrame([(r["device"], r["elem_tag"]) for r in want], "device STRING, elem_tag STRING")
    names = names.select(_name("device").alias("d"), _name("elem_tag").alias("t")).distinct()
    counts = keyed.join(F.broadcast(names), ["d", "t"]).groupBy("d", "t").count().collect()  # at most a row a category
    there = {(r["d"], r["t"]): r["count"] for r in counts}

    key = {(r["device"], r["elem_tag"]): r for r in want}
    # Targets that differ only in case or blanks draw from the same records, which the first of them gets.
    most, left = {}, dict(there)
    for device, tag in key:
        at = (device.strip().lower(), tag.strip().lower()) if device is not None and tag is not None else None
        most[(device, tag)] = left.pop(at, 0)
    wanted = _wanted({k: r["share"] for k, r in key.items()}, {k: r["least"] for k, r in key.items()}, most, size)
    rounded = controlled_rounding(wanted)
    overrun = max(sum(rounded.values()) - size, 0)
    rows = []
    for (device, tag), r in key.items():
        known = device is not None and tag is not None
        available = there.get((device.strip().lower(), tag.strip().lower()), 0) if known else 0
        quota, whole = max(math.ceil(r["share"] * size), r["least"]), rounded[(device, tag)]
        rows.append((device, tag, float(r["share"]), r["least"], available, quota, float(wanted[(device, tag)]), whole, whole, max(quota - available, 0), overrun))
    return spark.createDataFrame(rows, PLAN)


def target_sample(records: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """``rec_id, device, elem_tag`` of the sample: in each category of ``plan`` the ``taken`` records with the least random key.

    The key is a hash of ``rec_id`` and ``seed``, so that the sample doesn't depend on partitions or order. Keys of a category are
    counted by their leading bits; those before the bits of the last one drawn are in, and only those with the same bits are
    ranked, so that no task sorts a category. Null ids, devices and tags are never drawn, a repeated record is drawn once.
    """
    cells = plan.select(_name("device").alias("d"), _name("elem_tag").alias("t"), "taken").where("taken > 0")
    rows = records.select("rec_id", _name("device").alias("d"), _name("elem_tag").alias("t")).where("rec_id IS NOT NULL")
    rows = rows.groupBy("rec_id").agg(F.min(F.struct("d", "t")).alias("x")).select("rec_id", "x.d", "x.t")
    rows = rows.join(F.broadcast(cells), ["d", "t"]).withColumn("random", F.xxhash64("rec_id", F.lit(seed)))  # at most MOST_CATEGORIES
    rows = rows.withColumn("bits", F.shiftright("random", 64 - PREFIX_BITS))
    counts = rows.groupBy("d", "t", "taken", "bits").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("d", "t").orderBy("bits")) - F.col("n")  # a row for each of the bits
    counts = counts.withColumn("before", before).where("before < taken")
    rows = rows.join(counts.select("d", "t", "bits", "before", "n"), ["d", "t", "bits"])
    sure = rows.where("before + n <= taken")
    last = Window.partitionBy("d", "t").orderBy("random", "rec_id")
    border = rows.where("before + n > taken").withColumn("rank", F.row_number().over(last)).where("rank <= taken - before").drop("rank")
    return sure.unionByName(border).select("rec_id", F.col("d").alias("device"), F.col("t").alias("elem_tag"))


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "func_records").where("split = 'train'").select("rec_id", "device", "elem_tag")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories whose quota is larger than what the train split has."""
    plan = target_plan(_train(spark, sf_dir), table(spark, sf_dir, "sample_targets"))
    return plan.where("quota > available").select("device", "elem_tag")


def p4_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of every category."""
    return target_plan(_train(spark, sf_dir), table(spark, sf_dir, "sample_targets"))


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn records."""
    train = _train(spark, sf_dir)
    return target_sample(train, target_plan(train, table(spark, sf_dir, "sample_targets")))


P4_FOUND_SQL = """
WITH t AS (SELECT DISTINCT rec_id, lower(trim(device)) d, lower(trim(elem_tag)) t FROM func_records WHERE split = 'train' AND rec_id IS NOT NULL),
n AS (SELECT CAST(floor(count(DISTINCT rec_id) * CAST(0.05 AS DECIMAL(4,2))) AS BIGINT) size FROM func_records WHERE split = 'train'),
c AS (SELECT d, t, count(*) n FROM t GROUP BY d, t)
SELECT s.device, s.elem_tag FROM sample_targets s CROSS JOIN n LEFT JOIN c ON c.d = lower(trim(s.device)) AND c.t = lower(trim(s.elem_tag))
WHERE greatest(ceil(CAST(s.target_share AS DECIMAL(18,9)) * size), s.min_count) > coalesce(c.n, 0)
"""
