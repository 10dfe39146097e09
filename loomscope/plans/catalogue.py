"""The declared tasks: what each asks, of which documents, and how its answers are scored.

Documents have the columns that a task's prompt names and, where an element is looked for, ``box`` (in parts of the picture) and the ``coords``
that the response names (:func:`with_coords`).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomscope.functions import geometry as G
from loomscope.functions import parse as P
from loomscope.functions import text as X
from loomscope.operators.curate import QA_PROMPT
from loomscope.plans.tasks import Task, metric, register

# Prompts of the tasks.
LOCATE = "Locate the element according to its detailed functionality description. {{goal}} (Output the center coordinates of the target)"
STEP = "Given the UI screenshot and previous actions, please generate the next move necessary to advance towards task completion. The user's task is: {{goal}}\nAction history: {{history}}\n\nNow, first describe the action intent and then directly plan the next action."
REGION = "Direct a user to interact with the highlighted region {{region}}."


def with_coords(docs):
    """Answered documents (``response, scale``) with ``coords``, the point or box that each response names, read once for all metrics."""
    return docs.withColumn("coords", P.coordinates(F.col("response"), F.col("scale")))


@metric("center_acc")
def center_acc(df):
    return G.centre_hit(F.col("box"), F.col("coords"))


@metric("iou_acc")
def iou_acc(df):
    return F.coalesce(G.iou(F.col("coords"), F.col("box")) >= 0.5, F.lit(False))


@metric("center_dist")
def center_dist(df):
    return G.distance(G.centre(F.col("coords")), G.centre(F.col("box")))


@metric("squad_f1")
def squad_f1(df):
    return X.char_set_f1(F.col("target"), F.col("response"))


@metric("exact")
def exact(df):
    return F.coalesce(X.matches(F.col("target"), F.col("response"), case=True, punctuation=True), F.lit(False))


@metric("action_type_acc")
def action_type_acc(df):
    return F.coalesce(P.action_fields(F.col("response"))["action_type"] == F.col("action_type"), F.lit(False))


_AT_CENTRE = {"center_acc": "mean"}


def declare() -> None:
    """Registers the tasks and their groups (again)."""
    locate = Task("func_pred_rec_test", LOCATE, "box", where="split = 'test'", metrics=_AT_CENTRE)
    ask = Task("screenqa_short_test", QA_PROMPT + "\n{{question}}", "answer", metrics={"squad_f1": "mean"})
    plan = Task("aitw_test", STEP, "action_type", metrics={"action_type_acc": "mean"})
    for task, group in (
        (locate, "grounding"),
        (locate.extended(name="screenspot_rec_test"), "grounding"),
        (Task("screenspot_reg_test", REGION, "instruction", metrics={"squad_f1": "mean"}), "referring"),
        (locate.extended(name="screenspot_v2_rec_test"), "grounding"),
        (locate.extended(name="refexp_rec_test"), "grounding"),
        (plan.extended(name="motif_point_test"), "agents"),
        (locate.extended(name="vwb_ag_test", metrics=_AT_CENTRE | {"center_dist": "mean"}), "grounding"),
        (locate.extended(name="vwb_eg_test", metrics=_AT_CENTRE | {"center_dist": "mean"}), "grounding"),
        (plan, "agents"),
        (locate.extended(name="autoguiv2_funcregion_detect_test", where="split = 'val'", metrics={"iou_acc": "mean"}), "grounding"),
        (ask, "questions"),
        (ask.extended(name="screenqa_complex_test"), "questions"),
        (ask.extended(name="websrc_val", where="split = 'val'"), "questions"),
        (ask.extended(name="websrc_test", where="split = 'test'"), "questions"),
        (locate.extended(name="wic_point_test"), "grounding"),
    ):
        register(task, group)


declare()
