"""Bottom-k sketches of word sets and the candidate pairs that their inverted lists give.

One hash function orders all words. Its leading bits are the word's class, which says in what share of the documents a
word occurs (class 0: in less than one of ``RARE`` documents), the others are a uniform hash. A word set is kept as the
sorted array of these ranks; its sketch is the bottom k of them, with the k that the threshold needs: two sets that
are alike (:data:`ALIKE`) share a rank among the first ``3 * n / 10 + 1``, so inverted lists of retained ranks hold
every alike pair.

Lists are cut by their measured length. The entries of a list of more than :data:`LIST_GOAL` are listed again under the
rank together with each further retained one, up to :data:`DEPTH` ranks: a pair of the list meets under the first ranks
that both sets share. What is still longer is split into blocks that many tasks scan.

Each entry knows how many ranks of its set come before the shared ones (none of them is shared) and an odd sketch of
those behind (64 parity bits). For two entries of a list, the ranks before and the bits that differ bound the differing
words of the union from below; pairs whose bound already rules out the threshold go no further. The bound never drops
an alike pair; what is left is verified exactly by the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscope.session import written

#: Two word sets are alike if 10 * shared >= 7 * union, that is 17 * differing <= 3 * (size_a + size_b).
ALIKE = (7, 10)
#: Documents are counted by the low bits of their words' hashes; a table of this size goes to the driver and to all tasks.
BUCKETS = 1 << 18
#: A word in at most one of so many documents is of class 0; each further class doubles the share.
RARE = 4096
CLASS_BITS = 6
#: A list up to this length is scanned by one task; the entries of a longer one get another rank, up to DEPTH ranks.
LIST_GOAL, DEPTH = 4096, 3
#: Keys of long lists that may be sent to all tasks (8 bytes each); more are joined.
MOST_SENT_KEYS = 1 << 21
#: A list up to this length gives all its pairs at once; beyond it each entry gives at most as many pairs as
#: this, and what it may have left out is found after the first round, among entries not linked by then.
PARTNERS = 16
SMALL_LIST = 64
#: A two-sided list of more pairs than this is split; a part of it has at most about so many entries of each side.
LIST_PAIRS = 1 << 24
PART_ENTRIES = 1 << 15

COLUMNS = ("key", "id", "sig", "mark", "n", "skip", "side")
ENTRY = "key BIGINT, id BIGINT, sig BIGINT, mark BIGINT, n INT, skip INT, side INT"
FOUND = "a BIGINT, b BIGINT, " + ENTRY
PREFIX = "ARRAY<STRUCT<pos: INT, key: BIGINT>>"


def word_classes(docs: DataFrame, toks: str = "toks") -> np.ndarray:
    """The class of each of ``BUCKETS`` groups of word hashes, counted over all ``docs`` (``toks ARRAY<BIGINT>``).

    Words that share a bucket share its class: the order of words stays the same for all documents, which is all that
    the lists need. Counts of a fixed number of buckets reach the driver whatever the data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            lists = batch.column(0)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            counts[:BUCKETS] += np.bincount(flat & (BUCKETS - 1), minlength=BUCKETS)
            rows += batch.num_rows
        counts[BUCKETS] = rows
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])

    found = docs.select(toks).mapInArrow(run, "bucket BIGINT, n BIGINT").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS + 1, np.int64)
    counts[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    share = counts[:BUCKETS] * (RARE / max(int(counts[BUCKETS]), 1))
    return np.ceil(np.log2(np.maximum(share, 1))).astype(np.int8)


def ranked(docs: DataFrame, classes: np.ndarray, toks: str = "toks") -> DataFrame:
    """``docs`` with ``toks`` as the sorted ranks of their words."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)
    schema = docs.schema
    place = docs.columns.index(toks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = sent.value
        for batch in batches:
            lists = batch.column(place)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            n = np.diff(offsets)
            of = classes[flat & (BUCKETS - 1)].astype(np.int64)
            rank = (of << (63 - CLASS_BITS)) | (flat.view(np.uint64) >> np.uint64(CLASS_BITS + 1)).view(np.int64)
            rank = rank[np.lexsort((rank, np.repeat(np.arange(len(n)), n)))]
            columns = batch.columns
            columns[place] = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(rank))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the numbers start .. start+count-1, and the row of each."""
    count = np.maximum(count, 0)
    row = np.repeat(np.arange(len(count)), count)
    ends = np.cumsum(count)
    return start[row] + np.arange(len(row)) - np.repeat(ends - count, count), row


def _mix(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (y.view(np.uint64) + np.uint64(seed))
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (z ^ (z >> np.uint64(32))).view(np.int64)


def _held(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each of ``keys`` is one of the sorted ``of``."""
    return of[np.minimum(np.searchsorted(of, keys), len(of) - 1)] == keys if len(of) else np.zeros(len(keys), bool)


def _listing(depth: int, sent, which: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lists documents (``id, toks, side, mark, open``) from their open prefixes of ``depth - 1`` ranks on.

    ``sent`` has the sorted keys of the long lists of this and the following depths; an entry under one of them is listed
    one rank deeper instead. The depth after those is the last one. ``which`` depths to give: ``all``, the ``last`` one, or those ``before`` it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists, side, mark = batch.column(1), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            first, n = offsets[:-1] - offsets[0], np.diff(offsets)
            parity = np.bitwise_xor.accumulate(np.left_shift(np.uint64(1), flat.view(np.uint64) & np.uint64(63)))
            most = 3 * n // 10
            if depth == 1:
                row, pos, key = np.flatnonzero(n), np.full((n > 0).sum(), -1), np.zeros((n > 0).sum(), np.int64)
            else:
                opened = batch.column(4)
                row, inner = np.repeat(np.arange(len(n)), np.diff(opened.offsets.to_numpy())), opened.flatten()
                pos, key = (inner.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            out = []
            for d, long in enumerate([*sent.value, None], depth):
                pos, up = _spread(pos + 1, np.minimum(most[row] + d, n[row]) - pos - 1)
                row, at = row[up], first[row[up]] + pos
                key = _mix(key[up], flat[at], d)
                deeper = _held(key, long) if long is not None else np.zeros(len(key), bool)
                if which == "all" or (which == "last") == (long is None):
                    r, end, q = row[~deeper], at[~deeper], pos[~deeper]
                    sig = parity[first[r] + n[r] - 1] ^ parity[end]
                    out.append((key[~deeper], ids[r], sig.view(np.int64), mark[r], n[r], q - (d - 1), side[r], q))
                row, pos, key = row[deeper], pos[deeper], key[deeper]
            columns = [np.concatenate(c) for c in zip(*out)]
            kinds = [pa.int64()] * 4 + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds)], names=[*COLUMNS, "pos"])

    return run


def entries(docs: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """The inverted-list entries (:data:`ENTRY`) of ``docs``, and the ``key`` and ``length`` of lists that are still long.

    docs: ``id BIGINT, toks ARRAY<BIGINT>`` of :func:`ranked`, for sided lists ``side INT, mark BIGINT``. The lengths of all
    lists of a depth are counted; the keys of the long ones are sent to the tasks that list the documents, or,
    where they are too many for that, the prefixes to go on from are joined to the documents.
    """
    sc = docs.sparkSession.sparkContext
    if "side" not in docs.columns:
        docs = docs.withColumn("side", F.lit(0)).withColumn("mark", F.lit(-1).cast("bigint"))
    if "open" not in docs.columns:
        docs = docs.withColumn("open", F.lit(None).cast(PREFIX))
    docs = docs.select("id", "toks", "side", "mark", "open")
    sent: list[np.ndarray] = []

    def listed(which: str) -> DataFrame:
        return docs.mapInArrow(_listing(depth, sc.broadcast(list(sent)), which), ENTRY + ", pos INT")

    for d in range(depth, DEPTH + 1):
        found = listed("last")
        long = written(found.groupBy("key").agg(F.count("*").alias("length")).where(F.col("length") > LIST_GOAL), "long_lists")
        count = long.count()
        if d == DEPTH or count == 0:
            break
        if sum(map(len, sent)) + count > MOST_SENT_KEYS:
            opened = found.join(long, "key", "left_semi").groupBy("id").agg(F.collect_list(F.struct("pos", "key")).alias("open"))  # of one document: a few
            deeper, long_deeper = entries(docs.drop("open").join(opened, "id"), d + 1)
            done = found.join(long, "key", "left_anti")
            return (done.unionByName(listed("before")) if sent else done).select(*COLUMNS).unionByName(deeper), long_deeper
        sent.append(np.sort(long.toPandas()["key"].to_numpy(np.int64)))
    return listed("all").select(*COLUMNS), long


def marks_near(a: np.ndarray, b: np.ndarray, apart: int) -> np.ndarray:
    """Whether two marks (eight bytes each, -1 for none) may differ by at most ``apart`` on average; a byte is up to 2 too small."""
    bytes_a, bytes_b = (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).astype(np.int16) for x in (a, b))
    return (np.abs(bytes_a - bytes_b).sum(1) <= 8 * (apart + 2)) | (a == -1) | (b == -1)


def passes(a: dict, b: dict, sided: bool) -> np.ndarray:
    """Whether the entries ``a`` and ``b`` (columns) of one list may be alike; with ``sided`` they must be of different sides."""
    more = a["n"] - b["n"]
    sketch = np.bitwise_count((a["sig"] ^ b["sig"]).view(np.uint64)).astype(np.int64)
    behind = np.maximum(sketch, np.abs(more - a["skip"] + b["skip"]))
    differ = np.maximum(a["skip"] + b["skip"] + behind, np.maximum(2 * a["skip"] - more, 2 * b["skip"] + more))
    return (a["side"] != b["side"] if sided else a["id"] != b["id"]) & (17 * differ <= 3 * (a["n"] + b["n"]))


def _take(x: dict, rows: np.ndarray | slice) -> dict:
    return {k: v[rows] for k, v in x.items()}


def _small_lists(x: dict, sided: bool, mark_apart: int | None) -> tuple[np.ndarray, np.ndarray]:
    """All passing pairs of lists of up to SMALL_LIST entries; x is sorted by key."""
    key, out_a, out_b = x["key"], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    row = np.arange(len(key))
    for gap in range(1, SMALL_LIST):
        row = row[row + gap < len(key)]
        row = row[key[row] == key[row + gap]]
        if not len(row):
            break
        a, b = _take(x, row), _take(x, row + gap)
        good = passes(a, b, sided)
        if mark_apart is not None:
            good &= marks_near(a["mark"], b["mark"], mark_apart)
        out_a.append(a["id"][good]), out_b.append(b["id"][good])
    return np.concatenate(out_a), np.concatenate(out_b)


def _long_list(x: dict, sided: bool, mark_apart: int | None, most: int | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Passing pairs of one list, at most ``most`` for each entry, and whether that may have left some out.

    The partners of all entries are tried in one order, so that entries of one group of near copies choose the
    same partners.
    """
    x = _take(x, np.argsort(_mix(x["id"], np.zeros(len(x["id"]), np.int64), 3), kind="stable"))
    if sided:
        return _scan(_take(x, x["side"] == 1), _take(x, x["side"] == 0), True, mark_apart, most)
    return _scan(x, x, False, mark_apart, most)


def _scan(a: dict, b: dict, sided: bool, mark_apart: int | None, most: int | None, differ: str | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Passing pairs of two parts of a list (or of a list with itself) in blocks; ``differ``: a column in which the two must differ."""
    # The part of the bound that rules out most pairs, in few operations: differing sketch bits <= room_a + room_b.
    room_a, room_b = (np.clip((3 * y["n"] - 17 * y["skip"]) // 17 + d, -100, 63).astype(np.int8) for y, d in ((a, 0), (b, 1)))
    sig_a, sig_b = a["sig"].view(np.uint64), b["sig"].view(np.uint64)
    out_a, out_b, cut = [np.empty(0, np.int64)], [np.empty(0, np.int64)], False
    for lo in range(0, len(sig_b), 128):
        rows = slice(lo, lo + 128)
        had = np.zeros(len(sig_b[rows]), np.int64)
        for start in range(0, min(len(sig_a), lo + 128) if a is b else len(sig_a), 2048):
            cols = slice(start, start + 2048)
            bits = np.bitwise_count(sig_b[rows, None] ^ sig_a[None, cols]).view(np.int8)
            i, j = divmod(np.flatnonzero(bits <= room_b[rows, None] + room_a[None, cols]), bits.shape[1])
            if a is b:  # each pair once
                once = j + start < i + lo
                i, j = i[once], j[once]
            if mark_apart is not None:
                near = marks_near(a["mark"][j + start], b["mark"][i + lo], mark_apart)
                i, j = i[near], j[near]
            one, other = _take(a, j + start), _take(b, i + lo)
            good = passes(one, other, sided)
            if differ:
                good &= one[differ] != other[differ]
            i, j = i[good], j[good]
            if most is not None:
                rank = np.arange(len(i)) - np.searchsorted(i, i) + had[i]  # i is sorted
                cut |= bool((rank >= most).any())
                had += np.bincount(i, minlength=len(had))
                i, j = i[rank < most], j[rank < most]
            out_a.append(a["id"][j + start]), out_b.append(b["id"][i + lo])
            if most is not None and (had >= most).all() and start + 2048 < len(sig_a):
                cut = True
                break
    return np.concatenate(out_a), np.concatenate(out_b), cut


def _lists(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[dict, bool]]:
    """Cut the sorted entries of a partition into parts that end where a list ends: many short lists, or one long one."""
    kept: list[dict] = []
    size = 0

    def parts(x: dict) -> Iterator[tuple[dict, bool]]:
        key = x["key"]
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        length = np.diff(edges)
        long = length > SMALL_LIST
        for i in np.flatnonzero(long):
            yield _take(x, slice(edges[i], edges[i + 1])), True
        rest = np.repeat(~long & (length > 1), length)
        if rest.any():
            yield _take(x, rest), False

    for batch in batches:
        x = {k: batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i, k in enumerate(names)}
        kept.append(x)
        size += len(x["key"])
        if size < 200_000 or x["key"][0] == x["key"][-1] == kept[0]["key"][0]:
            continue
        x = {k: np.concatenate([y[k] for y in kept]) for k in names}
        last = int(np.searchsorted(x["key"], x["key"][-1]))
        yield from parts(_take(x, slice(last)))
        kept = [_take(x, slice(last, None))]
        size = len(kept[0]["key"])
    if size:
        yield from parts({k: np.concatenate([y[k] for y in kept]) for k in names})


def _batch(a: np.ndarray, b: np.ndarray, x: dict | None = None) -> pa.RecordBatch:
    n = len(a)
    cols = [pa.array(a, pa.int64()), pa.array(b, pa.int64())]
    for k, kind in zip(COLUMNS, (*[pa.int64()] * 4, *[pa.int32()] * 3), strict=True):
        cols.append(pa.nulls(n, kind) if x is None else pa.array(x[k]).cast(kind))
    return pa.RecordBatch.from_arrays(cols, names=["a", "b", *COLUMNS])


def _block(blocks: Column) -> Column:
    """The block of an entry, of so many of its list."""
    return F.pmod(F.xxhash64("id", F.lit("block")), blocks)


def _every(blocks: Column) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), blocks - 1)


def hub_lists(listed: DataFrame, long: DataFrame) -> DataFrame:
    """``listed`` with the ``long`` lists split into lists of about ``LIST_GOAL`` entries, and the key of the list in ``whole``.

    One block of a long list goes to all its parts: each entry meets the same few others. What that leaves out is for
    :func:`candidates_left`. Other lists have 0 in ``whole``.
    """
    if long.isEmpty():
        return listed.withColumn("whole", F.lit(0).cast("bigint"))
    rows = listed.join(long.select("key", F.ceil(F.col("length") / LIST_GOAL).alias("blocks")), "key", "left")
    own = _block(F.col("blocks"))
    part = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("bigint"))).when(own == 0, _every(F.col("blocks"))).otherwise(F.array(own))
    rows = rows.withColumn("part", F.explode(part)).withColumn("whole", F.when(F.col("blocks").isNotNull(), F.col("key")).otherwise(0))
    return rows.withColumn("key", F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", "part"))).select(*COLUMNS, "whole")


def split_lists(listed: DataFrame, long: DataFrame, mark_apart: int) -> DataFrame:
    """``listed`` with those ``long`` two-sided lists that have more than ``LIST_PAIRS`` pairs split into lists of their own, so that each pair
    whose marks may differ by at most ``mark_apart`` on average still meets in exactly one of them.

    Three signed sums of the eight means differ by no more than the means do together. An entry of side 1 goes to the
    cell of its sums, one of side 0 to the (up to eight) cells within the bound. Entries of side 1 without a mark have a cell to which
    all of side 0 with a mark go; those of side 0 without one meet all of side 1 in another. A cell is cut further
    into blocks of both sides, each of one with each of the other.
    """
    if long.isEmpty():
        return listed
    long = listed.join(long, "key", "left_semi").groupBy("key").agg(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 0).alias("n0"), F.count_if((F.col("side") == 0) & (F.col("mark") == -1)).alias("bare"))
    long = written(long.where(F.col("n0") * F.col("n1") > LIST_PAIRS).select("key", (F.col("bare") > 0).alias("bare")), "split_lists")
    if long.isEmpty():
        return listed
    most = 8 * (mark_apart + 2)
    width = 2 * most + 1
    means = [F.shiftrightunsigned("mark", 8 * k).bitwiseAND(F.lit(255)) for k in range(8)]
    sums = [sum((m if sign(k) else -m for k, m in enumerate(means)), F.lit(0)) for sign in (lambda k: True, lambda k: k < 4, lambda k: k % 2 == 0)]
    cell = lambda x: F.floor(x / width)
    own = F.concat_ws(",", *(cell(x).cast("string") for x in sums))

    def cross(prefixes: Column, x: Column) -> Column:
        cells = F.sequence(cell(x - most), cell(x + most))
        return F.flatten(F.transform(prefixes, lambda p: F.transform(cells, lambda c: F.concat_ws(",", p, c.cast("string")))))

    near = F.transform(F.sequence(cell(sums[0] - most), cell(sums[0] + most)), lambda c: c.cast("string"))
    for x in sums[1:]:
        near = cross(near, x)
    unmarked = F.col("mark") == -1
    of_one = F.concat(F.array(F.when(unmarked, "none").otherwise(own)), F.when(F.col("bare"), F.array(F.lit("all"))).otherwise(F.array().cast("array<string>")))
    of_zero = F.when(unmarked, F.array(F.lit("all"))).otherwise(F.concat(near, F.array(F.lit("none"))))
    columns = listed.columns
    entry = listed.join(long, "key")
    entry = entry.select(*columns, F.explode(F.when(F.col("side") == 1, of_one).otherwise(of_zero)).alias("cell"))
    sizes = entry.groupBy("key", "cell").agg(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 0).alias("n0")).where("n0 > 0 AND n1 > 0")
    sizes = sizes.select("key", "cell", *(F.ceil(F.col(c) / PART_ENTRIES).alias(c) for c in ("n1", "n0")))
    entry = entry.join(sizes, ["key", "cell"])
    is_one = F.col("side") == 1
    entry = entry.withColumn("with", F.explode(F.when(is_one, _every(F.col("n0"))).otherwise(_every(F.col("n1")))))
    parts = [F.when(is_one, _block(F.col("n1"))).otherwise(F.col("with")), F.when(is_one, F.col("with")).otherwise(_block(F.col("n0")))]
    entry = entry.withColumn("key", F.xxhash64("key", "cell", *parts)).select(*columns)
    return listed.join(long, "key", "left_anti").select(*columns).unionByName(entry)


def candidates(listed: DataFrame, long: DataFrame, mark_apart: int | None = None) -> DataFrame:
    """Candidate pairs of the inverted lists of :func:`entries` (:data:`FOUND`): rows with ``a`` and ``b``, and the entries of the lists
    that were not exhausted (``a`` and ``b`` null, the other columns set), for :func:`candidates_left`.

    With ``mark_apart`` lists are two-sided: all passing pairs of an entry of side 0 with one of side 1 whose marks may differ by
    at most that on average are given, and nothing is left. Long lists are split.
    """
    sided = mark_apart is not None
    listed = split_lists(listed, long, mark_apart) if sided else hub_lists(listed, long)
    names = COLUMNS if sided else (*COLUMNS, "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, long in _lists(batches, names):
            if not long:
                yield _batch(*_small_lists(x, sided, mark_apart))
                continue
            a, b, cut = _long_list(x, sided, mark_apart, None if sided else PARTNERS)
            yield _batch(a, b)
            if cut or (not sided and x["whole"][0]):
                none = pa.nulls(len(x["id"]), pa.int64())
                yield _batch(none, none, x | {"key": np.where(x["whole"] != 0, x["whole"], x["key"])})

    return listed.repartition("key").sortWithinPartitions("key").mapInArrow(run, FOUND)


def candidates_left(left: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (``a BIGINT, b BIGINT``) of the lists in ``left`` whose two entries have different labels so far.

    labels: ``id BIGINT, label BIGINT``; an id that is not there is its own label. Pairs within the most frequent label of
    a list are linked already: the other entries of the list meet all its entries, in blocks of both that many tasks scan.
    """
    rows = left.dropDuplicates(["key", "id", "skip", "sig"]).join(labels, "id", "left").select(*COLUMNS, F.coalesce("label", "id").alias("label"))
    rows = written(rows, "left")
    counts = rows.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"))
    counts = counts.select("key", F.col("top.label").alias("top"), (F.col("n") - F.col("top.n")).alias("few"), "n").where("few > 0")
    counts = counts.select("key", "top", *(F.ceil(F.col(c) / LIST_GOAL).alias(f"{c}_blocks") for c in ("few", "n")))
    rows = rows.join(written(counts, "left_counts"), "key")
    few = F.when(F.col("label") != F.col("top"), F.transform(_every(F.col("n_blocks")), lambda j: F.struct(F.lit(0).alias("side"), _block(F.col("few_blocks")).alias("i"), j.alias("j"))))
    each = F.transform(_every(F.col("few_blocks")), lambda i: F.struct(F.lit(1).alias("side"), i.alias("i"), _block(F.col("n_blocks")).alias("j")))
    rows = rows.withColumn("to", F.explode(F.concat(F.coalesce(few, F.slice(each, 1, 0)), each)))
    rows = rows.select(F.xxhash64("key", "to.i", "to.j").alias("key"), *(c for c in COLUMNS if c not in ("key", "side")), F.col("to.side").alias("side"), "label")
    names = ("key", *(c for c in COLUMNS if c not in ("key", "side")), "side", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _ in _lists(batches, names):
            for part in np.split(np.arange(len(x["key"])), np.flatnonzero(x["key"][1:] != x["key"][:-1]) + 1):
                y = _take(x, part)
                a, b, _ = _scan(_take(y, y["side"] == 1), _take(y, y["side"] == 0), True, None, None, "label")
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a BIGINT, b BIGINT")
