import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomscope.functions import actions as X
from loomscope.functions import geometry as G
from loomscope.functions import parse as P
from loomscope.functions import text as T
from loomscope.functions.words import words

CASES = [
    ("(91,6)", 100, [0.91, 0.06]),
    ("[0.12, 0.34]", 1000, [0.12, 0.34]),
    ("[1, 2] [3,4]", 100, [0.02, 0.03]),
    ("[1,2] [3,4]", 100, [0.03, 0.04]),
    ("[[012,034,200,300]]", 1000, [0.012, 0.034, 0.2, 0.3]),
    ("[[1012,2034,2200,2300]]", 1000, [0.001012, 0.002034, 0.0022, 0.0023]),
    ("<box>598 102 673 406</box>.", 1000, [0.598, 0.102, 0.673, 0.406]),
    ("text <box>(10,20),(30,40)</box>", 100, [0.1, 0.2, 0.3, 0.4]),
    ("<point>(5,6)</point>", 100, [0.05, 0.06]),
    ('Press it\n{"action_type": "click", "target": (384,171)}', 1000, [0.384, 0.171]),
    ("[a,b]", 100, None),
    ("", 100, None),
    ("(1,2,3)", 100, None),
    ("0.5 0.5", 100, [0.5, 0.5]),
    ("[500, 0.5]", 1000, [0.5, 0.0005]),
    ("[1d, 2f]", 100, None),
    (None, 100, None),
    ("]][[", 100, None),
    ("[x] then [3, 4] and [y]", 100, [0.03, 0.04]),
    ("[1, 2] " + "z" * 40 + " [3, 4]", 100, [0.03, 0.04]),
]


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first()[0]


def test_coordinates(spark):
    rows = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(CASES)], "i INT, t STRING, s INT")
    got = {r.i: r.c for r in rows.select("i", P.coordinates(F.col("t"), F.col("s")).alias("c")).collect()}
    for i, (text, _, want) in enumerate(CASES):
        assert (got[i] is None) == (want is None), text
        if want is not None:
            assert got[i] == pytest.approx(want), text


def test_coordinates_as_centre(spark):
    assert one(spark, "[10, 20, 30, 40]", "STRING", lambda t: P.coordinates(t, 100, keep_box=False)) == pytest.approx([0.2, 0.3])


def test_single_notation_parsers(spark):
    assert one(spark, "(1,2),(3,4) (5,6),(7,8)", "STRING", P.last_corners) == [5, 6, 7, 8]
    assert one(spark, "none", "STRING", P.last_corners) is None
    assert one(spark, "no list", "STRING", P.float_list) == [0, 0, 0, 0]
    assert one(spark, "<ref> (3,4) <ref>(5,6)", "STRING", P.ref_points) == [[3, 4], [5, 6]]
    assert one(spark, "x", "STRING", P.ref_points) == [[-100, -100]]
    assert one(spark, 'go {"action_type": "click", "target": (3,4)}', "STRING", lambda t: P.action_fields(t)["target"]) == [3, 4]
    assert one(spark, "a;b|c", "STRING", lambda t: P.until_stop(t, ["|", ";"])) == "a"


def test_iou_cases(spark):
    df = spark.createDataFrame([([0.0, 0.0, 1.0, 1.0], [0.5, 0.0, 1.5, 1.0]), ([0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0]), ([0.5, 0.5], [0.0, 0.0, 1.0, 1.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    got = [r[0] for r in df.select(G.iou(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(1 / 3) and got[1] is None and got[2] == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(*[st.floats(0, 1)] * 8), min_size=1, max_size=20))
def test_iou_is_symmetric_and_bounded(spark, rows):
    boxes = [([min(a, c), min(b, d), max(a, c), max(b, d)], [min(e, g), min(f, h), max(e, g), max(f, h)]) for a, b, c, d, e, f, g, h in rows]
    df = spark.createDataFrame(boxes, "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    for x, y in df.select(G.iou(F.col("a"), F.col("b")), G.iou(F.col("b"), F.col("a"))).collect():
        assert (x is None) == (y is None)
        if x is not None:
            assert math.isclose(x, y, abs_tol=1e-9) and -1e-9 <= x <= 1 + 1e-9


def test_centre_hit_edges_and_nulls(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.5, 0.5], [0.5, 0.5]), ([0.0, 0.0, 0.5, 0.5], [0.51, 0.5]), ([0.0, 0.0, 0.5, 0.5], None), ([0.0, 0.0, 0.5, 0.5], [0.0, 0.0, 1.0, 1.0])], "g ARRAY<DOUBLE>, p ARRAY<DOUBLE>")
    assert [r[0] for r in df.select(G.centre_hit(F.col("g"), F.col("p"))).collect()] == [True, False, False, True]


def test_tap_match(spark):
    df = spark.createDataFrame([([0.5, 0.5], [0.55, 0.5], []), ([0.1, 0.1], [0.9, 0.9], []), ([0.3, 0.3], [0.6, 0.6], [[0.3, 0.3, 0.5, 0.5]])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>, x ARRAY<ARRAY<DOUBLE>>")
    assert [r[0] for r in df.select(G.tap_match(F.col("a"), F.col("b"), F.col("x"))).collect()] == [True, False, True]


def test_texts(spark):
    df = spark.createDataFrame([("Hello World", "hello wrld"), ("", ""), ("ab", "xyz")], "a STRING, b STRING")
    got = df.select(T.anls(F.array("a"), F.col("b")), T.char_set_f1(F.col("a"), F.col("b")), T.token_f1(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == pytest.approx(1 - 1 / 11) and got[1][0] == 1 and got[2] == (0, 0, 0)
    assert one(spark, "a b", "STRING", lambda t: T.ngrams(F.split(t, " "), 3)) == []


def test_words(spark):
    assert one(spark, "Go <img>a/b.png</img> go <ref>É2</ref> x_y", "STRING", words) == ["go", "é2", "x", "y"]
    assert one(spark, None, "STRING", words) == []


def test_actions(spark):
    got = spark.range(12).select(X.action_of_id(F.col("id"))).collect()
    of = lambda i: (got[i][0].action_type, got[i][0].direction, got[i][0].goal_status)
    assert of(0) == ("swipe", "up", None) and of(8) == ("swipe", "right", None) and of(4) == ("click", None, None) and of(2) == (None, None, None)
    assert of(10) == ("status", None, "successful") and of(11) == ("status", None, "infeasible")
    status = lambda k: X.action_of_id(F.lit(k))
    same = spark.range(1).select(*(m for k in (10, 11) for m in X.formats_match(status(10), status(k), F.array(F.array(*[F.lit(0.0)] * 4))))).first()
    assert tuple(same) == (True, True, True, False)
    assert spark.range(1).select(X.object_type(F.lit(1)), X.object_type(F.lit(99))).first() == ("BUTTON", None)


def test_sizes(spark):
    row = spark.range(1).select(G.letterboxed(F.lit(1280.0), F.lit(720.0), 448), G.shrunk(F.lit(1280.0), F.lit(720.0), 640), F.size(G.tiles(F.lit(672), F.lit(336), 336, 168))).first()
    assert tuple(row[0]) == (448, 252, 0, 98) and tuple(row[1]) == (640, 360) and row[2] == 3


def test_element_actions(spark):
    cases = [
        ("named", 'so {"action_type": "click element", "bbox": [0.1, 0.2, 0.3, 0.4]}.', ("click", "", [0.1, 0.2, 0.3, 0.4])),
        ("named", '{"action_type": "type", "typed_text": "hi", "bbox": [0.1, 0.2]}', ("type", "hi", [0.1, 0.2])),
        ("named", '{"action_type": "type", "bbox": [0.1, 0.2]}', ("swipe", "", [0.5] * 4)),
        ("numbered", "{'action_type': 4, 'click_point': (0.1, 0.2)}", ("click", "", [0.1, 0.2])),
        ("numbered", "{'action_type': 3, 'typed_text': 'a (b)'}", ("type", "a (b)", [0.5, 0.5])),
        ("numbered", "{'action_type': 8}", ("swipe", "", [0.5] * 4)),
        ("numbered", "go {'action_type': 4, 'click_point': (0.1, 0.2)}", ("swipe", "", [0.5] * 4)),
        ("grounded", "Plan. Grounded Operation: tap [[100,200,300,400]]", ("click", "", [0.1, 0.2, 0.3, 0.4])),
        ("grounded", "Grounded Operation: tap [[100,200]]", ("click", "", [0.1, 0.2])),
        ("grounded", "Grounded Operation: type typed_text:milk, then", ("type", "milk", [0.5] * 4)),
        ("grounded", "tap somewhere", ("swipe", "", [0.5] * 4)),
        ("grounded", None, ("swipe", "", [0.5] * 4)),
    ]
    for dialect, text, want in cases:
        got = spark.createDataFrame([(text,)], "t STRING").select(X.element_action(F.col("t"), dialect).alias("a")).first().a
        assert (got.action_type, got.typed_text, got.box) == want, text
