"""Points and boxes as column expressions. A box is an array of four numbers x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(a: Column, i: int) -> Column:
    """Item ``i`` (0-based) of an array, null beyond its end."""
    return F.try_element_at(a, F.lit(i + 1))


def size_of(image_size: Column) -> tuple[Column, Column]:
    """Width and height of a text ``WxH``; null if it isn't one."""
    return tuple(F.split_part(image_size, F.lit("x"), F.lit(i)).try_cast("double") for i in (1, 2))


def normalised(box: Column, image_size: Column) -> Column:
    """A pixel box in parts of the picture's width and height."""
    w, h = size_of(image_size)
    return F.when(box.isNotNull() & (w > 0) & (h > 0), F.array(at(box, 0) / w, at(box, 1) / h, at(box, 2) / w, at(box, 3) / h))


def from_corner_and_size(box: Column) -> Column:
    """A box x, y, width, height as corners."""
    return F.array(at(box, 0), at(box, 1), at(box, 0) + at(box, 2), at(box, 1) + at(box, 3))


def denormalised(box: Column, image_size: Column) -> Column:
    """A normalised box in whole pixels, halves to the even number."""
    w, h = size_of(image_size)
    return F.array(*(F.bround(at(box, i) * (w, h)[i % 2], 0) for i in range(4)))


def centre(coords: Column) -> Column:
    """The point itself if there are two numbers, the middle of a box if there are four, else (-1, -1); null for null."""
    n = F.size(coords)
    middle = F.array((at(coords, 0) + at(coords, 2)) / 2, (at(coords, 1) + at(coords, 3)) / 2)
    return F.when(n == 2, coords).when(n == 4, middle).when(coords.isNotNull(), F.array(F.lit(-1.0), F.lit(-1.0)))


def inside(point: Column, box: Column) -> Column:
    """Whether a point lies in a box, edges included."""
    return at(point, 0).between(at(box, 0), at(box, 2)) & at(point, 1).between(at(box, 1), at(box, 3))


def centre_hit(gold: Column, predicted: Column) -> Column:
    """Whether a predicted point, or the middle of a predicted box, lies in the gold box; false without a prediction."""
    return F.coalesce(inside(centre(predicted), gold), F.lit(False))


def width_height(box: Column) -> tuple[Column, Column]:
    return at(box, 2) - at(box, 0), at(box, 3) - at(box, 1)


def area(box: Column) -> Column:
    w, h = width_height(box)
    return w * h


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 unless both have four numbers, null if the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(at(a, 2), at(b, 2)) - F.greatest(at(a, 0), at(b, 0)))
    h = F.greatest(F.lit(0.0), F.least(at(a, 3), at(b, 3)) - F.greatest(at(a, 1), at(b, 1)))
    both = w * h
    boxes = (F.size(a) == 4) & (F.size(b) == 4)
    return F.when(boxes, F.try_divide(both, area(a) + area(b) - both)).otherwise(0.0)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((at(a, 0) - at(b, 0)) ** 2 + (at(a, 1) - at(b, 1)) ** 2)


def inflated(box: Column, part: float = 1.4) -> Column:
    """A normalised box whose sides grow by ``part`` of their length, half on each side, cut at the picture's edge."""
    w, h = width_height(box)
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(
        F.greatest(zero, at(box, 0) - w * part / 2),
        F.greatest(zero, at(box, 1) - h * part / 2),
        F.least(one, at(box, 2) + w * part / 2),
        F.least(one, at(box, 3) + h * part / 2),
    )


def tap_match(a: Column, b: Column, boxes: Column, near: float = 0.14) -> Column:
    """Whether two taps are the same: both in one of the inflated ``boxes``, or at most ``near`` apart."""
    together = F.exists(boxes, lambda x: inside(a, inflated(x)) & inside(b, inflated(x)))
    return F.coalesce(together, F.lit(False)) | F.coalesce(distance(a, b) <= near, F.lit(False))


def is_tap(start: Column, end: Column, near: float = 0.04) -> Column:
    """Whether a gesture from ``start`` to ``end`` is a tap."""
    return distance(start, end) <= near


def main_axis(start: Column, end: Column) -> Column:
    """0 if a drag goes mainly along x (ties too), else 1."""
    return F.when(F.abs(at(end, 0) - at(start, 0)) >= F.abs(at(end, 1) - at(start, 1)), 0).otherwise(1)


def tiles(w: Column, h: Column, window: int, stride: int) -> Column:
    """Corners x, y of all windows of a side that fit into a picture, rows first."""
    xs = F.sequence(F.lit(0), F.greatest(F.lit(0), w - window), F.lit(stride))
    ys = F.sequence(F.lit(0), F.greatest(F.lit(0), h - window), F.lit(stride))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))


def best_grid(w: Column, h: Column, grids: list[tuple[int, int]]) -> Column:
    """Of picture sizes the one that keeps most of the picture's pixels, then the one that wastes least, then the first."""
    kinds = []
    for order, (gw, gh) in enumerate(grids):
        scale = F.least(F.lit(gw) / w, F.lit(gh) / h)
        kept = F.least(F.floor(w * scale) * F.floor(h * scale), w * h)
        kinds.append(F.struct((-kept).alias("kept"), (F.lit(gw * gh) - kept).alias("waste"), F.lit(order).alias("ord"), F.lit(gw).alias("w"), F.lit(gh).alias("h")))
    return F.array_min(F.array(*kinds))


def closest_ratio(w: Column, h: Column, grids: list[tuple[int, int]], side: int = 448) -> Column:
    """The grid with the closest aspect ratio; of equal ones a later one only if the picture has over half its pixels."""
    kinds = F.array(*(F.struct(F.lit(a).alias("w"), F.lit(b).alias("h")) for a, b in grids))
    off = lambda g: F.abs(w / h - g["w"] / g["h"])
    better = lambda best, g: (off(g) < off(best)) | ((off(g) == off(best)) & (w * h > 0.5 * side * side * g["w"] * g["h"]))
    return F.aggregate(kinds, kinds[0], lambda best, g: F.when(better(best, g), g).otherwise(best))


def letterboxed(w: Column, h: Column, side: int) -> Column:
    """Size and offset of a picture scaled into a square of ``side`` and centred."""
    nw = F.when(w >= h, F.lit(side)).otherwise(F.least(F.ceil(w * side / h), F.lit(side)))
    nh = F.when(w >= h, F.least(F.ceil(h * side / w), F.lit(side))).otherwise(F.lit(side))
    return F.struct(nw.cast("int").alias("w"), nh.cast("int").alias("h"), F.floor((side - nw) / 2).cast("int").alias("x"), F.floor((side - nh) / 2).cast("int").alias("y"))


def shrunk(w: Column, h: Column, most: int) -> Column:
    """Size of a picture whose longer side is at most ``most``."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(w, h))
    return F.struct((w * scale).cast("int").alias("w"), (h * scale).cast("int").alias("h"))


def patches(w: Column, h: Column, side: int, most: int) -> Column:
    """Rows and columns of patches of a side, at most ``most`` together, at the picture's ratio."""
    scale = F.sqrt(F.lit(float(most)) * side / h * side / w)
    fit = lambda x: F.greatest(F.lit(1), F.least(F.floor(scale * x / side).cast("int"), F.lit(most)))
    return F.struct(fit(h).alias("rows"), fit(w).alias("columns"))


def point_text(box: Column, scale: int = 100) -> Column:
    """The middle of a normalised box as text, in whole parts of ``scale`` or, at scale 1, with two decimals."""
    return _text(centre(box), scale)


def box_text(box: Column, scale: int = 100) -> Column:
    """A normalised box as text, in whole parts of ``scale`` or, at scale 1, with two decimals."""
    return _text(box, scale)


def _text(numbers: Column, scale: int) -> Column:
    whole = F.transform(numbers, lambda x: (x * scale).cast("int").cast("string") if scale > 1 else F.format_string("%.2f", x))
    return F.concat(F.lit("("), F.array_join(whole, ","), F.lit(")"))
