"""Responses to points, boxes and actions, as column expressions without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomscope.functions.geometry import at

# Notations of numbers and coordinates.
FLOAT = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
NUMBER = r"-?\d+\.?\d*"
BRACKETS = r"\[(.*?)\]"
CORNERS = r"\((\d+,\d+)\),\((\d+,\d+)\)"
POINT_TAG = r"<point>\((\d+),(\d+)\)</point>"
REF_POINT = r"<ref>\s*\((\d+),(\d+)\)"
LOC = r"<loc_(\d+)>"


def floats(parts: Column) -> Column:
    """Texts as numbers; null if one of them isn't a plain number."""
    numbers = F.transform(parts, lambda p: F.when(p.rlike(FLOAT), F.trim(p).try_cast("double")))
    return F.when(~F.exists(numbers, lambda x: x.isNull()), numbers)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def last_corners(text: Column) -> Column:
    """The last ``(x,y),(x,y)`` as four numbers, or null."""
    found = [F.try_element_at(_all(text, CORNERS, g), F.lit(-1)) for g in (1, 2)]
    return floats(F.split(F.concat_ws(",", *found), ",")).cast("array<double>")


def point_tag(text: Column) -> Column:
    """The first ``<point>(x,y)</point>``, or null."""
    return F.when(text.rlike(POINT_TAG), F.array(*(F.regexp_extract(text, POINT_TAG, g).cast("double") for g in (1, 2))))


def ref_points(text: Column) -> Column:
    """All points after ``<ref>``; without one the point (-100, -100)."""
    xs, ys = (F.transform(_all(text, REF_POINT, g), lambda v: v.cast("int")) for g in (1, 2))
    found = F.zip_with(xs, ys, lambda x, y: F.array(x, y))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.array(F.lit(-100), F.lit(-100))))


def float_list(text: Column) -> Column:
    """The first bracket of four numbers, else four zeros."""
    number = r"\s*(-?\d+(?:\.\d+)?)\s*"
    pattern = rf"\[{number},{number},{number},{number}\]"
    return F.when(text.rlike(pattern), F.array(*(F.regexp_extract(text, pattern, g).cast("double") for g in range(1, 5)))).otherwise(F.array(*[F.lit(0.0)] * 4))


def loc_tokens(text: Column, most: float = 999.0, count: int = 4) -> Column:
    """The first ``count`` location tokens that follow each other, in parts of ``most``; zeros without so many."""
    run = "".join([LOC] * count)
    return F.when(text.rlike(run), F.array(*(F.regexp_extract(text, run, g).cast("double") / most for g in range(1, count + 1)))).otherwise(F.array(*[F.lit(0.0)] * count))


def box_text_numbers(text: Column) -> Column:
    """A box given as text, ``[x1, y1, x2, y2]``, as whole numbers; null if one isn't."""
    numbers = F.transform(F.split(F.trim(F.translate(text, "[]", "  ")), r"\s*,\s*"), lambda x: x.try_cast("int"))
    return F.when((F.size(numbers) == 4) & ~F.exists(numbers, lambda x: x.isNull()), numbers)


def scaled_to(coords: Column, scale: Column, width: Column, height: Column) -> Column:
    """Coordinates in parts of ``scale``; a scale of -1 means pixels, which are divided by the picture's size."""
    side = lambda i: F.when(i % 2 == 0, width).otherwise(height)
    return F.transform(coords, lambda x, i: x / F.when(scale == -1, side(i)).otherwise(scale))


def coordinates(text: Column, scale: Column | int = 1000, keep_box: bool = True) -> Column:
    """The point or box that a response names, two or four numbers up to 1; null if it names none.

    In order: what stands between the first two words "action"; double brackets (in parts of ``scale``); the last
    bracket that holds numbers, averaged with the bracket just before it where both are points written with ", ";
    whole numbers after a leading box tag; the last pair of corners if there is a box tag; all numbers. Numbers
    are divided by ``scale`` if any exceeds 1. Another count than two or four is no answer.
    """
    scale = F.lit(scale).cast("double") if isinstance(scale, int) else scale.cast("double")
    act = F.trim(F.try_element_at(F.split(text, "action"), F.lit(2)), F.lit(" \t\n\r\x0b\x0c"))
    return let(F.when(text.contains("action"), act).otherwise(text), lambda t: _coordinates(t, scale, keep_box))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _coordinates(t: Column, scale: Column, keep_box: bool) -> Column:
    opened, closed = F.locate("[[", t), F.locate("]]", t)
    double = floats(F.split(F.substring(t, opened + 2, F.greatest(closed - opened - 2, F.lit(0))), ","))
    double = F.transform(double, lambda x: x / scale)

    def single(inner: Column) -> Column:
        tried = F.transform(inner, lambda s, i: F.struct(i.alias("i"), floats(F.split(s, ",")).alias("v")))

        def averaged(last: Column) -> Column:
            between = F.length(F.try_element_at(F.split(t, BRACKETS, -1), last["i"] + 1))
            other = floats(F.split(F.try_element_at(inner, F.when(last["i"] > 0, last["i"])), ", "))
            near = (F.size(last["v"]) == 2) & (last["i"] > 0) & (between < 30)
            mean = let(other, lambda o: F.when(F.size(o) == 2, F.zip_with(last["v"], o, lambda a, b: (a + b) / 2)).otherwise(last["v"]))
            return F.when(near, mean).otherwise(last["v"])

        return let(F.try_element_at(F.filter(tried, lambda x: x["v"].isNotNull()), F.lit(-1)), averaged)

    def bracketed(inner: Column) -> Column:
        return F.when(F.size(inner) > 0, single(inner)).otherwise(general)

    digits = F.transform(_all(t, r"\d+"), lambda v: v.cast("double"))
    numbers = F.transform(_all(t, NUMBER), lambda v: v.cast("double"))
    general = F.when(t.contains("<box>"), last_corners(t)).otherwise(numbers)
    found = (
        F.when(t.contains("[[") & (closed > 0), double)
        .when(t.contains("[[") | ~t.contains("[") & ~t.startswith("<box>"), general)
        .when(t.contains("["), let(_all(t, BRACKETS, 1), bracketed))
        .otherwise(digits)
    )

    def scaled(c: Column) -> Column:
        if not keep_box:
            middle = F.array((at(c, 0) + at(c, 2)) / 2, (at(c, 1) + at(c, 3)) / 2)
            c = F.when(F.size(c) == 4, middle).otherwise(c)
        return F.when(F.exists(c, lambda x: x > 1), F.transform(c, lambda x: x / scale)).otherwise(c)

    return let(found, lambda c: F.when(F.size(c).isin(2, 4), scaled(c)))


def action_fields(text: Column) -> Column:
    """Type, target and other members of the last ``{"`` of a response; a tuple counts as a list."""
    cut = F.element_at(F.split(text, r'\{"', -1), -1)
    json = F.when(text.contains('{"'), F.translate(F.concat(F.lit('{"'), cut), "()", "[]"))
    json = F.regexp_extract(json, r"^(\{.*\})", 1)
    return F.from_json(json, "action_type STRING, target ARRAY<DOUBLE>, direction STRING, text STRING, goal_status STRING")


def until_stop(text: Column, stops: list[str]) -> Column:
    """``text`` up to the first of any stop sequence."""
    for stop in stops:
        text = F.substring_index(text, stop, 1)
    return text
