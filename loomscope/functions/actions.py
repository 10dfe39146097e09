"""Agent actions: formats and matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomscope.functions.geometry import centre, tap_match

# Names of the types of user-interface objects by their numbers from 0, and numbers of actions and swipes.
OBJECT_TYPES = (
    "UNKNOWN", "BUTTON", "CHECKBOX", "CHECKEDTEXTVIEW", "EDITTEXT", "IMAGEBUTTON", "IMAGEVIEW", "RADIOBUTTON", "SLIDINGDRAWER", "SPINNER", "SWITCH", "TABWIDGET", "TEXTVIEW", "TOGGLEBUTTON", "VIDEOVIEW",
)
ACTION_IDS = {"type": 3, "click": 4, "swipe": 0}
SWIPES = {0: "up", 1: "down", 8: "right", 9: "left"}


def object_type(number: Column) -> Column:
    """The name of an object type."""
    return F.try_element_at(F.array(*(F.lit(x) for x in OBJECT_TYPES)), number + 1)


def action_text(kind: Column, point: Column, typed: Column) -> Column:
    """An action as the text that a model is trained to give; ``point`` in parts of 100."""
    whole = lambda i: F.floor(F.try_element_at(point, F.lit(i))).cast("int").cast("string")
    target = F.concat(F.lit("("), whole(1), F.lit(","), whole(2), F.lit(")"))
    return (
        F.when(kind == "click", F.concat(F.lit('{"action_type": "click", "target": '), target, F.lit("}")))
        .when(kind == "type", F.concat(F.lit('{"action_type": "input_text", "text": "'), F.coalesce(typed, F.lit("")), F.lit('"}')))
        .when(kind == "swipe", F.lit('{"action_type": "swipe"}'))
    )


#: Members of an action as all formats give them; a point is (y, x).
ACTION = "struct<action_type:string,target:array<double>,direction:string,text:string,goal_status:string>"

# What the numbers of actions mean besides clicks and swipes.
NUMBERED = {3: "input_text", 5: "navigate_back", 6: "navigate_home", 7: "enter", 10: "status", 11: "status"}
GOAL_STATUS = {10: "successful", 11: "infeasible"}


def _action(kind: Column, target: Column, direction: Column, text: Column, goal_status: Column) -> Column:
    return F.struct(
        kind.alias("action_type"), F.when(kind == "click", target).cast("array<double>").alias("target"), F.when(kind == "swipe", direction).alias("direction"),
        F.when(kind == "input_text", text).alias("text"), F.when(kind == "status", goal_status).alias("goal_status"),
    )


def _named(number: Column, names: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(number == k, v).otherwise(out)
    return out


def action_of_id(number: Column, click_point: Column | None = None, typed: Column | None = None) -> Column:
    """A predicted action with a number as :data:`ACTION`: numbers of swipes name their direction; null type for an unknown number."""
    kind = F.when(number == ACTION_IDS["click"], "click").when(number.isin(*SWIPES), "swipe").otherwise(_named(number, NUMBERED))
    none = F.lit(None)
    point = F.reverse(click_point) if click_point is not None else none
    return _action(kind, point, _named(number, SWIPES), F.lower(typed) if typed is not None else none.cast("string"), _named(number, GOAL_STATUS))


def action_of_row(number: Column, kind: Column, touch: Column, addition: Column, typed: Column) -> Column:
    """A labelled action as :data:`ACTION`: number 4 is a click or, by its kind, a swipe in the direction that ends ``addition``."""
    tap = number == ACTION_IDS["click"]
    name = F.when(tap & (kind == "click"), "click").when(tap, "swipe").otherwise(_named(number, NUMBERED))
    words = F.filter(F.split(addition, r"\s+"), lambda w: w != "")
    return _action(name, F.reverse(touch), F.try_element_at(words, F.lit(-1)), typed, _named(number, GOAL_STATUS))


def action_of_fields(fields: Column, scale: float) -> Column:
    """A predicted action with members (of ``parse.action_fields``) as :data:`ACTION`; its target is in parts of ``scale``."""
    target = F.transform(F.reverse(fields["target"]), lambda x: x / scale)
    return _action(fields["action_type"], target, fields["direction"], F.lower(fields["text"]), fields["goal_status"])


#: What :func:`element_action` gives; ``box`` is a box or a point.
ELEMENT_ACTION = "struct<action_type:string,typed_text:string,box:array<double>>"


def element_action(text: Column, dialect: str) -> Column:
    """The click, text or swipe that a response names, as :data:`ELEMENT_ACTION` with coordinates in parts of one.

    Dialects: ``named`` (JSON whose ``action_type`` holds the action's name, with ``bbox`` and ``typed_text``), ``numbered`` (nothing but a literal whose
    ``action_type`` is a number, with ``click_point``, a point or a box, and ``typed_text``) and ``grounded`` (a sentence behind
    "Grounded Operation:" with double brackets in thousandths). Whatever can't be read is a swipe, which is at the centre.
    """
    whole, nothing = F.array(*[F.lit(0.5)] * 4), F.lit("")
    action = lambda kind, typed, box: F.struct(F.lit(kind).alias("action_type"), typed.alias("typed_text"), box.cast("array<double>").alias("box")).cast(ELEMENT_ACTION)
    swipe = action("swipe", nothing, whole)
    if dialect == "named":
        read = F.from_json(F.regexp_extract(text, r"(?s)(\{.*?\})", 1), "action_type STRING, typed_text STRING, bbox ARRAY<DOUBLE>")
        kind, typed, box = read["action_type"], read["typed_text"], read["bbox"]
        found = F.when(kind.contains("click"), F.when(box.isNotNull(), action("click", nothing, box)))
        found = found.when(kind.contains("type"), F.when(typed.isNotNull() & box.isNotNull(), action("type", typed, box)))
    elif dialect == "numbered":
        listed = F.regexp_replace(F.when(text.rlike(r"(?s)^\s*\{.*\}\s*$"), text), r"\(([\d\s.,]*)\)", "[$1]")
        read = F.from_json(listed, "action_type INT, typed_text STRING, click_point ARRAY<DOUBLE>")
        kind, typed, point = read["action_type"], read["typed_text"], read["click_point"]
        found = F.when(kind == ACTION_IDS["click"], F.when(F.size(point).isin(2, 4), action("click", nothing, point)))
        found = found.when(kind == ACTION_IDS["type"], F.when(typed.isNotNull(), action("type", typed, F.coalesce(point, F.array(F.lit(0.5), F.lit(0.5))))))
    elif dialect == "grounded":
        said = F.element_at(F.split(text, "Grounded Operation:", -1), -1)
        numbers = lambda n: F.transform(F.split(F.nullif(F.regexp_extract(said, r"\[\[(" + ",".join([r"\d+"] * n) + r")\]\]", 1), F.lit("")), ","), lambda x: x.cast("double") / 1000)
        box = F.coalesce(numbers(4), numbers(2))
        typed = F.split_part(F.nullif(F.split_part(said, F.lit("typed_text:"), F.lit(2)), F.lit("")), F.lit(","), F.lit(1))
        found = F.when(said.contains("tap"), F.when(box.isNotNull(), action("click", nothing, box)))
        found = found.when(said.contains("type"), F.when(typed.isNotNull(), action("type", typed, whole)))
    else:
        raise ValueError(f"unknown dialect {dialect}")
    return F.coalesce(found, swipe)


#: Accuracies by the kind of the labelled action: which actions each is over.
BY_KIND = {
    "click_acc": ("click", None), "text_acc": ("input_text", None), "swipe_acc": ("swipe", None), "enter_acc": ("enter", None), "home_acc": ("navigate_home", None),
    "back_acc": ("navigate_back", None), "complete_acc": ("status", "successful"), "infeasible_acc": ("status", "infeasible"),
}


def accuracy_by_kind(gold: Column, matched: Column) -> list[Column]:
    """Aggregates: for each name of :data:`BY_KIND` the share of matched actions, 0 without any."""
    out = []
    for name, (kind, status) in BY_KIND.items():
        of = (gold["action_type"] == kind) & (gold["goal_status"].eqNullSafe(F.lit(status)) if status else F.lit(True))
        share = F.try_divide(F.count_if(of & matched).cast("double"), F.count_if(of))
        out.append(F.round(F.coalesce(share, F.lit(0.0)), 6).alias(name))
    return out


def formats_match(gold: Column, predicted: Column, boxes: Column) -> tuple[Column, Column]:
    """:func:`actions_match` of two actions of :data:`ACTION`; ``boxes`` as x1, y1, x2, y2 like the points' mirrored axes."""
    point = lambda a: F.reverse(a["target"])
    one = lambda a: {"kind": a["action_type"], "box": point(a), "text": a["text"], "direction": a["direction"], "goal_status": a["goal_status"]}
    return actions_match(one(gold), one(predicted), boxes)


def text_match(a: Column, b: Column) -> Column:
    """Whether two typed texts are equal or one holds the other, without regard to case."""
    a, b = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    return (a == b) | a.contains(b) | b.contains(a)


def actions_match(gold: dict[str, Column], predicted: dict[str, Column], boxes: Column) -> tuple[Column, Column]:
    """Whether the types match, and whether the whole actions match.

    Both have ``kind``, ``box``, ``text`` and ``direction``, and may have ``goal_status``. Clicks match as taps, texts by
    containment, swipes by direction, statuses by what they state, other kinds by kind.
    """
    none = F.lit(None).cast("string")
    same = F.coalesce(gold["kind"] == predicted["kind"], F.lit(False))
    full = (
        F.when(gold["kind"] == "click", tap_match(centre(gold["box"]), centre(predicted["box"]), boxes))
        .when(gold["kind"].isin("type", "input_text"), text_match(gold["text"], predicted["text"]))
        .when(gold["kind"] == "swipe", gold["direction"].eqNullSafe(predicted["direction"]))
        .when(gold["kind"] == "status", gold.get("goal_status", none).eqNullSafe(predicted.get("goal_status", none)))
        .otherwise(True)
    )
    return same, same & full
