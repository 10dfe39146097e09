"""The training-data operators against brute force on small tables, and on nulls, empties, long texts, ties, copies and clashing columns."""

import random
import re
import time
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomscope.llm import broken_pairs as B
from loomscope.llm import cross_split as X
from loomscope.llm import mixing as M
from loomscope.llm import near_duplicates as N
from loomscope.llm import packing as P
from loomscope.llm import sketches as S
from loomscope.llm import stuffed_pages as U
from loomscope.llm import target_sample as T
from loomscope.llm.tokens import encoding, hilbert

def clash(df):
    """``df`` with further columns named like those that the operators make."""
    names = ("id", "a", "b", "n", "toks", "label", "side", "mark", "count", "size", "rank", "page", "tilt", "rate", "copies", "curve", "n_tokens", "d", "t")
    return df.withColumns({c: F.lit(1) for c in names if c not in df.columns})


def word_set(text):
    text = re.sub(r"<[^>]*>", " ", re.sub(r"(?s)<img>.*?</img>", " ", (text or "").lower()))
    return frozenset(re.findall(r"[^\W_]+", text))


def alike(a, b):
    return 10 * len(a & b) >= 7 * len(a | b)


def groups(texts):
    sets = {k: word_set(t) for k, t in texts.items()}
    parent = {k: k for k, s in sets.items() if s}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(parent)
    for i, x in enumerate(keys):
        for y in keys[i + 1 :]:
            if alike(sets[x], sets[y]):
                lo, hi = sorted((root(x), root(y)))
                parent[hi] = lo
    return {k: root(k) for k in keys if root(k) != k}


def make_texts(seed, n):
    """Texts over a small vocabulary (all frequent) and over rare names, with edits of edits."""
    draw = random.Random(seed)
    common = [f"w{i}" for i in range(40)]
    out = {}
    for k in range(n):
        if out and draw.random() < 0.5:
            words = (out[draw.choice(list(out))] or "x").split()
            for _ in range(draw.randint(0, 4)):
                if not words:
                    break
                i = draw.randrange(len(words))
                words[i : i + 1] = draw.choice([[], [draw.choice(common)], [words[i], draw.choice(common)]])
            draw.shuffle(words)
        else:
            words = draw.sample(common, draw.randint(1, 22)) + [f"name{draw.randrange(10**6)}" for _ in range(draw.randint(0, 4))]
        out[k * 3 + 1] = " ".join(words)
    return out


@pytest.mark.parametrize("seed, rare, goal, partners, small, sent", [(1, 4096, 4096, 16, 64, 1 << 21), (2, 100, 20, 2, 4, 1 << 21), (3, 1, 5, 1, 2, 0), (4, 20, 40, 1, 3, 12)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, seed, rare, goal, partners, small, sent):
    for name, value in (("RARE", rare), ("LIST_GOAL", goal), ("PARTNERS", partners), ("SMALL_LIST", small), ("MOST_SENT_KEYS", sent)):
        monkeypatch.setattr(S, name, value)
    texts = make_texts(seed, 220)
    texts |= {2: None, 5: "", 8: " .. <b> ", 11: "long " * 20000 + "text", 14: "text long"}
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "key BIGINT, text STRING")
    df = clash(df.union(df.limit(40)).withColumn("field_name", F.lit("f")))
    got = {r.member_key: r.group_key for r in N.near_duplicates(df).collect()}
    assert got == groups(texts)


def test_near_duplicates_hot_copies_and_fields(spark):
    rows = [("f", i, "the same words again and again") for i in range(300)] + [("g", i, "the same words again and again") for i in range(5)] + [("f", None, "x")]
    df = spark.createDataFrame(rows, "field_name STRING, key BIGINT, text STRING")
    got = [(r.field_name, r.group_key, r.member_key) for r in N.near_duplicates(df).collect()]
    assert len(got) == len(set(got)) == 299 + 4 and {g[1] for g in got} == {0}


def test_near_duplicates_of_nothing(spark):
    assert N.near_duplicates(spark.createDataFrame([], "field_name STRING, key BIGINT, text STRING")).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.id: r.label for r in N.components(spark.createDataFrame(chain, "a BIGINT, b BIGINT")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in range(100, 140)}) == 1 and got[0] != got[100]


def talk(*messages):
    return [(s, c) for s, c in messages]


THINGS = ["lamp", "sofa", "chart", "route", "novel", "ticket", "kettle", "puzzle"]
ASK = ("user", "Please describe what the element in the upper corner of the page does.")
FRAGE = ("user", "Was bewirkt das Element, das oben auf der Seite zu sehen ist?")


def labelled(spark):
    """Texts of two languages."""
    en = [f"The button in the upper corner opens the list of all {a}s that are on the page, and what the {b} in the middle does is shown to the user with this element." for a in THINGS for b in THINGS]
    de = [f"Die Schaltfläche öffnet die Liste der {a}, und danach wird die Karte mit den Angaben gezeigt. Was bewirkt das Element, das oben auf der Seite zu sehen ist? Bestellungen {b}" for a in ("Lampen", "Reise", "Bücher") for b in ("Uhr", "Zug")]
    return spark.createDataFrame([(t, "en") for t in en] + [(t, "DE") for t in de * 8] + [(None, "en"), ("x", None), ("y", "und")], "text STRING, lang STRING")


def fillers():
    """Sound pairs, and refusals in many wordings."""
    german = [FRAGE, ("assistant", "Es öffnet die Liste, und danach wird die Karte mit den Angaben gezeigt.")]
    sound = [f"It opens the list of all the {a}s that are in the {b}." for a in THINGS for b in THINGS] + [f"I can find the {a} when I press it, says the label of the {b}." for a in THINGS for b in THINGS[:3]] + [f"Tap the {a} icon beside the {b} to open it." for a in THINGS for b in THINGS]
    short = [f"{v} {t}" for v in ("Save", "Open", "Print") for t in THINGS] + [f"Call Mr {n}" for n in ("Adams", "Brown", "Clark", "Davis")]
    fahrt = [FRAGE, ("assistant", "Die Karte zeigt, wann der nächste Zug nach Berlin fährt.")]
    refusing = [f"{a} {b}." for a in ("I'm sorry, but", "Unfortunately,", "My apologies, but") for b in ("I cannot help with that request", "I can't answer this", "I am unable to look at pictures", "I must decline to respond to this", "this request is not something I can help with")]
    return [talk(ASK, ("assistant", t)) for t in sound + short] + [german] * 12 + [fahrt] * 9 + [talk(ASK, ("assistant", t)) for t in refusing], len(refusing)


def test_broken_pairs(spark):
    cases = [
        (talk(("user", "What is it?")), "empty"),
        (talk(("user", "What is it?"), ("assistant", None)), "empty"),
        (talk(("user", "What is it?"), ("assistant", " ... ")), "empty"),
        (talk(("user", "What is it?"), ("user", "Well?")), "empty"),
        (talk(("human", "Where is it?"), ("gpt", "(12,")), "truncated"),
        (talk(("human", "Where is it?"), ("gpt", "<box>(1,2),(3,4)</bo")), "truncated"),
        (talk(("human", "Where is it?"), ("gpt", "<point>(1,2)</point>")), None),
        (talk(("user", "What should I do with it now?"), ("assistant", "1. Open the page.\n2.")), "truncated"),
        (talk(("user", "What is it for?"), ("assistant", "It opens the list of all the lamps that")), "truncated"),
        (talk(("user", "What is it for?"), ("assistant", "I'm sorry, but I cannot help with that request.")), "refusal"),
        (talk(("user", "What is it for?"), ("assistant", 'It opens the help page "I can\'t sign in" of the site.')), None),
        (talk(("user", "What is it for?"), ("assistant", "The card declines the offer and closes the page without saving it.")), None),
        (talk(("user", "<image>\nTell me what the green button on the left side does."), ("assistant", "Tell me what the green button on the left does.")), "copy"),
        (talk(("user", "Where is this one: the green button on the left side of the page."), ("assistant", "The green button on the left side of the page: (3,4)")), None),
        (talk(ASK, ("assistant", "Es öffnet die Liste, und danach wird die Karte mit den Angaben gezeigt.")), "language"),
        (talk(("user", "Write a German notice for the element in the middle of the page."), ("assistant", "Es öffnet die Liste, und danach wird die Karte mit den Angaben gezeigt.")), None),
        (talk(ASK, ("assistant", "Save copy")), None),
        (talk(("user", "Say it all."), ("assistant", "It is long. " * 20000)), None),
        (talk(ASK, ("assistant", "Es öffnet Bestellungen.")), "language"),
        (talk(ASK, ("assistant", "Эта кнопка открывает список.")), "language"),
        (talk(("user", "Что делает эта кнопка?"), ("assistant", "Эта кнопка открывает список.")), None),
        (talk(("user", "Che cosa fa questo pulsante nella parte alta dello schermo?"), ("assistant", "Apre la lista degli ordini che sono stati inviati ieri.")), None),
        (talk(ASK, ("assistant", "Blue button with white label in the upper right corner")), None),
        (talk(ASK, ("assistant", "I won't be charged when I press it, says the label of the lamp that is in the list on the page.")), None),
        (talk(ASK, ("assistant", "Sadly I am unable to respond, as this is not something to help with.")), "refusal"),
    ]
    fill, refusing = fillers()
    rows = [(1000 + i, c) for i, c in enumerate(fill)] + [(i, c) for i, (c, _) in enumerate(cases)] + [(500, None), (501, []), (None, cases[0][0])]
    df = spark.createDataFrame(rows, "sample_id BIGINT, conversations ARRAY<STRUCT<sender: STRING, content: STRING>>")
    got = {}
    for r in B.broken_pairs(clash(df.union(df)), clash(labelled(spark))).collect():
        assert (r.sample_id, r.msg_index) not in got
        got[(r.sample_id, r.msg_index)] = r.defect
    want = {(i, 0): d for i, (_, d) in enumerate(cases) if d} | {(1000 + len(fill) - 1 - i, 0): "refusal" for i in range(refusing)}
    want[(3, 1)] = "empty"
    assert got == want


def test_broken_pairs_judges_short_ends(spark):
    cases = [("Tap the carpet icon beside", "truncated"), ("Tap the sofa icon beside", "truncated"), ("Die Karte", "truncated"), ("Tap the", "truncated"),
             ("Save carpet", None), ("Call Mr Evans", None), ("Open lamp", None)]
    rows = [(1000 + i, c) for i, c in enumerate(fillers()[0])] + [(i, talk(FRAGE if t == "Die Karte" else ASK, ("assistant", t))) for i, (t, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "sample_id BIGINT, conversations ARRAY<STRUCT<sender: STRING, content: STRING>>")
    got = {r.sample_id: r.defect for r in B.broken_pairs(df, labelled(spark)).collect() if r.defect == "truncated"}
    assert got == {i: d for i, (_, d) in enumerate(cases) if d}


def test_broken_pairs_of_nothing(spark):
    nothing = spark.createDataFrame([], "sample_id BIGINT, conversations ARRAY<STRUCT<sender: STRING, content: STRING>>")
    some = spark.createDataFrame([(1, talk(ASK))], nothing.schema)
    assert B.broken_pairs(nothing, labelled(spark)).count() == 0
    assert [tuple(r) for r in B.broken_pairs(some, labelled(spark).limit(0)).collect()] == [(1, 0, "empty")]


def picture(grey, comment=False, plain=False):
    h, w = grey.shape
    head = f"P{2 if plain else 5}\n{'# made' + chr(10) if comment else ''}{w} {h}\n255\n".encode()
    return head + (" ".join(map(str, grey.ravel())).encode() if plain else grey.astype(np.uint8).tobytes())


def test_cross_split_equals_brute_force(spark):
    draw = np.random.default_rng(5)
    texts = make_texts(9, 120)
    bases = [draw.integers(0, 256, (16, 24)) for _ in range(3)] + [draw.integers(0, 256, (24, 16))]
    rows = []
    for i, (k, t) in enumerate(texts.items()):
        grey = np.clip(bases[i % 4] + draw.integers(-12, 13, bases[i % 4].shape) * (i % 2), 0, 255)
        if i % 5 == 0:
            grey = grey.repeat(2, 0).repeat(2, 1)
        rows.append((k, ("train", "test", "val")[i % 3], t, bytearray(picture(grey, i % 2, i % 3 == 0))))
    rows += [(9001, "test", None, rows[0][3]), (9002, "train", rows[0][2], None), (9003, "test", rows[0][2], bytearray(b"nothing")), (9004, None, rows[0][2], rows[0][3])]
    df = spark.createDataFrame(rows, "rec_id BIGINT, split STRING, func STRING, image BINARY")
    got = [(r.eval_id, r.train_id) for r in X.cross_split_overlaps(clash(df.union(df.limit(50)))).collect()]

    def grey_apart(x, y):
        if x.shape[0] < y.shape[0]:
            x, y = y, x
        if x.shape == (2 * y.shape[0], 2 * y.shape[1]):
            x = x.reshape(y.shape[0], 2, y.shape[1], 2).mean((1, 3))
        return np.abs(x - y).mean() if x.shape == y.shape else 1e9

    known = [(k, s, word_set(t), X.decode(bytes(i)).astype(float)) for k, s, t, i in rows[:-4]]
    want = {(a[0], b[0]) for a in known if a[1] != "train" for b in known if b[1] == "train" and alike(a[2], b[2]) and grey_apart(a[3], b[3]) <= 10}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_long_sided_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(S, "LIST_PAIRS", 1000)
    monkeypatch.setattr(S, "PART_ENTRIES", 50)
    draw = np.random.default_rng(7)
    base = draw.integers(40, 215, (20, 8))
    means = np.clip(base[draw.integers(0, 20, 900)] + draw.integers(-16, 17, (900, 8)), 0, 254).astype(np.uint8)
    marks = means.view(np.int64).ravel().copy()
    marks[::85] = -1
    side = (np.arange(900) % 3 > 0).astype(int)
    rows = [(5, i, 0, int(m), 10, 0, int(x)) for i, (m, x) in enumerate(zip(marks, side))]
    rows += [(6, i, 0, int(marks[i]), 10, 0, int(side[i])) for i in range(20)]
    listed, long = spark.createDataFrame(rows, S.ENTRY), spark.createDataFrame([(5, 900)], "key BIGINT, length BIGINT")
    split = S.split_lists(listed, long, 10)
    pairs = {(min(r.a, r.b), max(r.a, r.b)) for r in S.candidates(listed, long, 10).collect()}
    zero, ones = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    a, b = (x.ravel() for x in np.meshgrid(zero, ones))
    near = S.marks_near(marks[a], marks[b], 10)
    assert pairs == {(min(x, y), max(x, y)) for x, y in zip(a[near].tolist(), b[near].tolist())}
    longest = split.groupBy("key").agg(F.count_if(F.col("side") == 1).alias("n1")).agg(F.max("n1")).first()[0]
    assert longest < 100  # 600 of one list before
    once = split.where("side = 0").alias("x").join(split.where("side = 1").alias("y"), "key").groupBy("x.id", "y.id").count()
    assert once.where("count > 1").count() <= 20 * 20  # only pairs of the second list meet twice


def test_a_family_of_a_third_of_all_rows_is_split(spark, monkeypatch):
    """Near copies that share all frequent words: no list in one task, one group, few pairs."""
    monkeypatch.setattr(S, "LIST_GOAL", 50)
    draw = random.Random(8)
    family = [" ".join([f"w{i}" for i in range(20)] + [f"x{draw.randrange(40)}", f"y{draw.randrange(40)}"]) for _ in range(1000)]
    others = [" ".join(f"z{draw.randrange(3000)}" for _ in range(12)) for _ in range(2000)]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(family + others)], "field_name STRING, key BIGINT, text STRING")
    sizes = []
    scan = S.candidates

    def candidates(listed, long):
        hub = S.hub_lists(listed, long)
        sizes.append((hub.groupBy("key").count().agg(F.max("count")).first()[0], scan(listed, long).where("a IS NOT NULL").count()))
        return scan(listed, long)

    monkeypatch.setattr(S, "candidates", candidates)
    got = {r.member_key: r.group_key for r in N.near_duplicates(df).collect()}
    assert all(got.get(i) == 0 for i in range(1, 1000))
    assert sizes[0][0] <= 4 * 50 and sizes[0][1] < 1000 * 999 / 4


def test_cross_split_of_nothing(spark):
    assert X.cross_split_overlaps(spark.createDataFrame([], "rec_id BIGINT, split STRING, func STRING, image BINARY")).count() == 0


def test_pictures():
    grey = np.arange(384).reshape(16, 24) % 256
    for kind in ({}, {"comment": True}, {"plain": True}):
        assert (X.decode(picture(grey, **kind)) == grey).all()
    assert X.decode(b"P5 24 16 255 short") is None and X.decode(None) is None and X.decode(b"") is None


def test_controlled_rounding_keeps_margins():
    draw = random.Random(3)
    for _ in range(20):
        cells = {(r, c): Decimal(draw.randint(0, 4000)) / 1000 for r in range(draw.randint(1, 5)) for c in range(draw.randint(1, 6))}
        whole = T.controlled_rounding(cells)
        near = lambda w, x: abs(w - x) < 1
        assert all(near(whole[k], x) for k, x in cells.items())
        assert near(sum(whole.values()), sum(cells.values()))
        for part in (0, 1):
            for v in {k[part] for k in cells}:
                assert near(sum(w for k, w in whole.items() if k[part] == v), sum(x for k, x in cells.items() if k[part] == v))


def test_target_sample(spark):
    rows = [(i, " Web " if i % 2 else "MOBILE", "a" if i % 3 else "b ") for i in range(1000)] + [(5000 + i, None, "a") for i in range(20)] + [(None, "web", "a")]
    df = spark.createDataFrame(rows, "rec_id BIGINT, device STRING, elem_tag STRING")
    df = clash(df.union(df.limit(100)))
    targets = spark.createDataFrame([("web", "a", 0.5, 1), ("mobile", "a", 0.25, 1), ("mobile", "b", 0.2, 1), ("web", "canvas", 0.05, 4), (None, "a", 0.0, 1)], "device STRING, elem_tag STRING, target_share DOUBLE, min_count INT")
    plan = T.target_plan(df, targets)
    by = {(r.device, r.elem_tag): r for r in plan.collect()}
    assert by[("web", "canvas")].quota == 4 and by[("web", "canvas")].short == 4 and by[(None, "a")].available == 0
    assert sum(r.rounded for r in by.values()) == 51 and by[("web", "a")].quota == 26
    drawn = T.target_sample(df, plan)
    a, b = ({r.rec_id for r in d.collect()} for d in (drawn, T.target_sample(df.repartition(7), plan)))
    counts = {(r.device, r.elem_tag): r["count"] for r in drawn.groupBy("device", "elem_tag").count().collect()}
    assert a == b and len(a) == drawn.count() and counts == {k: r.taken for k, r in by.items() if r.taken}
    assert T.target_plan(df.limit(0), targets).where("available > 0").count() == 0
    assert T.target_plan(df, targets.limit(0)).count() == 0


def test_target_sample_of_a_hot_category(spark):
    """One category with nearly all of 200,000 rows: the drawn keys are the least ones and few are ranked."""
    df = spark.range(200_000).select(F.col("id").alias("rec_id"), F.lit("web").alias("device"), F.when(F.col("id") % 1000 == 0, "b").otherwise("a").alias("elem_tag"))
    targets = spark.createDataFrame([("web", "a", 0.5, 1), ("web", "b", 0.5, 1)], "device STRING, elem_tag STRING, target_share DOUBLE, min_count INT")
    plan = T.target_plan(df, targets)
    assert {r.elem_tag: r.taken for r in plan.collect()} == {"a": 9800, "b": 200}  # what b lacks, a gives
    drawn = T.target_sample(df, plan).where("elem_tag = 'a'")
    least = df.where("elem_tag = 'a'").orderBy(F.xxhash64("rec_id", F.lit(7))).limit(9800)
    assert drawn.count() == 9800 and drawn.join(least, "rec_id").count() == 9800
    ranges = df.where("elem_tag = 'a'").groupBy(F.shiftright(F.xxhash64("rec_id", F.lit(7)), 64 - T.PREFIX_BITS)).count()
    assert ranges.agg(F.max("count")).first()[0] < 200


def test_target_plan_says_when_minima_are_too_many(spark):
    df = spark.range(100).select(F.col("id").alias("rec_id"), F.lit("web").alias("device"), F.when(F.col("id") < 50, "a").otherwise("b").alias("elem_tag"))
    targets = spark.createDataFrame([("web", "a", 0.9, 6), ("web", "b", 0.1, 7)], "device STRING, elem_tag STRING, target_share DOUBLE, min_count INT")
    got = {r.elem_tag: (r.taken, r.overrun) for r in T.target_plan(df, targets).collect()}
    assert got == {"a": (6, 8), "b": (7, 8)}


def test_hilbert_neighbours():
    side = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = hilbert(side, 3)
    assert sorted(key) == list(range(512))
    walk = side[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_packing(spark):
    draw = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "list", "page", "open"]
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(1, 120)))) for i in range(800)] + [(900 + i, "copy of one text " * 10) for i in range(300)]
    rows += [(2000, None), (2001, ""), (2002, " ".join(draw.choices(words, k=3000)))]
    docs = clash(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    limits = spark.createDataFrame([("s", 100), ("m", 700), ("none", 0)], "plan_name STRING, capacity_tokens INT")
    boxes = P.packed(docs, limits).cache()
    own = encoding("/opt/tokenizers/byte_bpe_50k.tiktoken")
    sizes = {i: len(own.encode_ordinary(t)) for i, t in rows if t is not None}
    for plan, capacity in (("s", 100), ("m", 700)):
        got = {}
        for r in boxes.where(F.col("plan_name") == plan).orderBy("doc_id", "piece").collect():
            got.setdefault(r.doc_id, []).append((r.from_token, r.n_tokens))
        assert {i: sum(n for _, n in p) for i, p in got.items()} == sizes
        assert all(len(p) == 1 for i, p in got.items() if sizes[i] <= capacity)
        assert all(p[k][0] == sum(n for _, n in p[:k]) for p in got.values() for k in range(len(p)))
    fill = P.container_fill(boxes, limits)
    assert fill.where("fill > 1").count() == 0
    assert fill.groupBy().agg(F.sum("tokens") / F.sum("capacity_tokens")).first()[0] > 0.9
    assert P.packed(docs.limit(0), limits).count() == 0 and P.packed(docs, limits.limit(0)).count() == 0


def test_mixing(spark):
    draw = random.Random(2)
    rows = [(i, ("big", "mid", "small")[0 if i % 10 else 1 if i % 20 else 2], "word " * draw.randint(1, 200)) for i in range(3000)]
    rows += [(9000, None, "x"), (9001, "big", None), (9002, "big", "")]
    docs = clash(spark.createDataFrame(rows, "doc_id BIGINT, source STRING, text STRING"))
    targets = spark.createDataFrame([("p", "big", 0.5, 1), ("p", "mid", 0.3, 2), ("p", "small", 0.15, 3), ("p", "absent", 0.05, 2)], "plan_name STRING, source STRING, target_share DOUBLE, max_repeats INT")
    chosen = M.mixed(docs, targets).cache()
    assert chosen.where("doc_id >= 9000").count() == 0 and chosen.count() == chosen.select("doc_id").distinct().count()
    most = {r.source: r.most for r in chosen.groupBy("source").agg(F.max("copies").alias("most")).collect()}
    assert most["big"] == 1 and most["mid"] <= 2 and most["small"] <= 3
    shares = {r.source: r for r in M.mix_shares(chosen, targets).collect()}
    assert shares["absent"].tokens == 0
    for s, want in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert shares[s].actual_share == pytest.approx(want / 0.95, rel=0.02)
    assert M.mixed(docs.limit(0), targets).count() == 0 and M.mixed(docs, targets.limit(0)).count() == 0


def test_stuffed_pages(spark):
    things = "order list icon page card map note timer badge panel lamp sofa desk rug vase bed chair tray shelf clock hat coat scarf glove boot belt ring bag purse tie".split()
    tell = lambda n, k=0: "".join(f"The {things[(i + k) % 30]} in row {i} shows what was sent to the {things[(i * 7 + k) % 30]} {i * 13}. " for i in range(n))
    sachen = "Karte Liste Notiz Anzeige Tafel Uhr Lampe Vase Kanne Tasse Gabel Schere Nadel Leiter Kiste Truhe Kette Brille Jacke Hose".split()
    sagen = lambda n, k=0: "".join(f"Die {sachen[(i + k) % 20]} zeigt, was an die {sachen[(i * 7 + k) % 20]} {i * 17} zu der Seite gesendet wird. " for i in range(n))
    prose = tell(6)
    russian = "Эта кнопка открывает список заказов, который был отправлен вчера. После нажатия появляется окно с данными пользователя. Если поле остаётся пустым, сначала проверьте настройки."
    chinese = "这个按钮会打开昨天发送的订单列表。点击之后会出现一个带有用户数据的窗口。如果该字段为空,请先检查设置。"
    italian = "Questo pulsante apre la lista degli ordini che sono stati inviati ieri. Dopo il tocco compare una finestra con i dati. Se il campo resta vuoto, bisogna prima controllare le impostazioni."
    dutch = "Deze knop opent de lijst met bestellingen die gisteren zijn verzonden. Na het tikken verschijnt een venster met gegevens. Als het veld leeg blijft, controleer dan eerst de instellingen."
    cases = [
        (prose, "en", False), ("cheap lamp buy lamp\n" * 20, "en", True), ("Tags: lamp, sofa, best chair, cheap desk, red rug, blue vase, top bed", "EN", True),
        ('<a href="http://x.test/a">Red Lamp</a>\n[Blue Sofa](http://y.test/p)\nwww.z.test/b' * 5, None, True), (prose + "Home | Shop | Help", None, False),
        ("Why green lamp? Because green lamp means green lamp! Get the green lamp, the only green lamp for all who need a green lamp. " * 4, "en", True),
        (sagen(1), "de", False), (None, "en", False), ("", None, False), (" \n ", "und", False), (tell(40000), "en", False), (prose + "\nMineral Blue, Visa Coral, Rating Teal", "und", False),
        ("order list icon page card map note timer badge panel order badge map icon card list", "en", True), ("list icon page card map note timer badge panel order badge map icon card list", "und", True),
        (russian, "ru", False), (chinese, "zh", False), (italian, "it", False), (dutch, "nl", False), (russian, None, False), (chinese, "und", False), (italian, None, False),
        ("купить лампу дёшево, лампа цена, лампа скидка, купить лампу, лампа отзывы, лампа онлайн, купить лампу, лампа" , "ru", True),
        ("http://x.test/a http://y.test/bcd\n" * 4 + "目录", "zh", True),
    ]
    rows = [(i, t, g) for i, (t, g, _) in enumerate(cases)]
    rows += [(1000 + i, tell(2 + i % 9, i) if i % 3 else sagen(2 + i % 7, i), "en" if i % 3 else "de") for i in range(240)]
    df = clash(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING"))
    got = {r.doc_id: r.stuffed for r in U.stuffed_pages(df).collect()}
    assert {i: got[i] for i in range(len(cases))} == {i: s for i, (_, _, s) in enumerate(cases)}
    assert not any(s for i, s in got.items() if i >= 1000)
    assert U.stuffed_pages(df.union(df)).where("stuffed").count() == 2 * sum(s for _, _, s in cases)
    assert U.stuffed_pages(df.limit(0)).count() == 0


def test_pages_are_cut_as_the_patterns_say():
    draw = random.Random(3)
    signs = ["a", "lamp", "x1", "_", "é", "目录", "。", "！", "？", ".", "!", "?", '"', "'", "”", ")", "\n", "\n\n", " ", "\t", "\x1c", "\x85", "\xa0", "|", ",", ";", "/", "*", "•", "–", "²"]
    for some in (signs, [c for c in signs if c.isascii()]):
        for _ in range(500):
            text = "".join(draw.choices(some, k=draw.randrange(40)))
            assert U._segments(text) == [s for s in re.split(r"(?<=[.!?])[\"'”»)]*\s+|(?<=[。！？])|\n+", text) if s]
            assert U._words(text) == U.WORD.findall(text) and U._separators(text) == len(U.SEPARATOR.findall(text))


def test_page_statistics_cost_a_few_readings_of_the_words():
    draw = random.Random(5)
    said = [f"w{i}" for i in range(3000)]
    texts = [" ".join(" ".join(draw.choices(said[: 30 + 30 * (i % 90)], k=12)) + draw.choice([". ", ",\n"]) for _ in range(14)) for i in range(2000)]
    profiles = U.Profiles({g: {w: i < 20 for i, w in enumerate(said[k::4])} for k, g in enumerate(("de", "en", "es", "fr"))})
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts), pa.array(["en", "de", "es", None] * 500)], ["doc_id", "text", "lang"])

    def seconds(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(lambda: U.page_statistics(batch, profiles)) < 3 * seconds(lambda: [set(U.WORD.findall(t)) for t in texts])


def test_page_ids_beside_a_missing_one_are_kept(spark):
    df = spark.createDataFrame([(2**53 + 1, "a lamp", "en"), (None, "a desk", "en")], "doc_id BIGINT, text STRING, lang STRING").coalesce(1)
    assert {r.doc_id for r in U.stuffed_pages(df).collect()} == {2**53 + 1, None}


def test_registered_queries(spark):
    from loomscope.llm.queries import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES)
    for name in ("p2_by_defect", "p3_report", "p4_plan", "p5_waste", "p6_shares", "p7_by_language"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0
