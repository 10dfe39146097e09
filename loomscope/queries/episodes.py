"""Episodes: histories, action texts, matching and success. The prediction that is scored repeats the step before."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomscope.functions import actions as X
from loomscope.functions import geometry as G
from loomscope.operators import history as H
from loomscope.queries.registry import query
from loomscope.session import table

#: Pixels of the screens on which boxes are given.
WIDTH, HEIGHT = 1440.0, 2560.0
#: Cells of the grid in each direction in which points and boxes of a trace meet.
CELLS = 16


def steps(spark, d, *columns):
    """The distinct steps with some columns; ``box`` is the box in parts of the screen."""
    given = ["ui_pos_obj_screen_bbox" if c == "box" else c for c in columns]
    s = table(spark, d, "episode_steps").select("trace_id", "step_id", *given).distinct()
    if "box" not in columns:
        return s
    b = F.col("ui_pos_obj_screen_bbox")
    return s.withColumn("box", F.when(b.isNotNull(), F.array(G.at(b, 0) / WIDTH, G.at(b, 1) / HEIGHT, G.at(b, 2) / WIDTH, G.at(b, 3) / HEIGHT)))


def scored(spark, d):
    """Steps with the flags of the prediction that repeats the step before it; a swipe always counts."""
    w = Window.partitionBy("trace_id").orderBy("step_id")
    before = {f"p_{c}": F.lag(c).over(w) for c in ("step_action", "box", "ui_pos_obj_input_str")}
    s = steps(spark, d, "step_action", "box", "ui_pos_obj_input_str").withColumns(before).withColumn("scenario", F.split_part("trace_id", F.lit("_"), F.lit(1)))
    gold = {"kind": F.col("step_action"), "box": F.col("box"), "text": F.col("ui_pos_obj_input_str"), "direction": F.lit(None)}
    predicted = {"kind": F.col("p_step_action"), "box": F.col("p_box"), "text": F.col("p_ui_pos_obj_input_str"), "direction": F.lit(None)}
    kind, full = X.actions_match(gold, predicted, F.array("box"))
    return s.withColumns({"type_ok": kind.cast("int"), "step_ok": full.cast("int"), "acc": F.when(F.col("step_action") == "swipe", 1).otherwise(full.cast("int"))})


T_SQL = """
t0 AS (SELECT DISTINCT trace_id, step_id, goal, instr, step_action, ui_pos_obj_screen_bbox b, ui_pos_obj_type, ui_pos_obj_desc_str, ui_pos_obj_input_str FROM episode_steps),
t AS (SELECT *, CASE WHEN b IS NOT NULL THEN [b[1] / 1440.0, b[2] / 2560.0, b[3] / 1440.0, b[4] / 2560.0] END box FROM t0)"""
M_SQL = f"""{T_SQL},
m0 AS (SELECT *, split_part(trace_id, '_', 1) scenario, lag(step_action) OVER w pk, lag(box) OVER w pb, lag(ui_pos_obj_input_str) OVER w pt FROM t WINDOW w AS (PARTITION BY trace_id ORDER BY step_id)),
m1 AS (SELECT *, (box[1] + box[3]) / 2 gx, (box[2] + box[4]) / 2 gy, (pb[1] + pb[3]) / 2 px, (pb[2] + pb[4]) / 2 py, (box[3] - box[1]) * 0.7 iw, (box[4] - box[2]) * 0.7 ih, lower(coalesce(ui_pos_obj_input_str, '')) gt, lower(coalesce(pt, '')) pl FROM m0),
m2 AS (SELECT *, CASE WHEN step_action = pk THEN 1 ELSE 0 END type_ok,
  CASE step_action WHEN 'click' THEN coalesce(gx BETWEEN greatest(0.0, box[1] - iw) AND least(1.0, box[3] + iw) AND gy BETWEEN greatest(0.0, box[2] - ih) AND least(1.0, box[4] + ih) AND px BETWEEN greatest(0.0, box[1] - iw) AND least(1.0, box[3] + iw) AND py BETWEEN greatest(0.0, box[2] - ih) AND least(1.0, box[4] + ih), false) OR coalesce(sqrt(power(gx - px, 2) + power(gy - py, 2)) <= 0.14, false)
  WHEN 'type' THEN contains(gt, pl) OR contains(pl, gt) ELSE true END fo FROM m1),
m AS (SELECT *, CASE WHEN type_ok = 1 AND fo THEN 1 ELSE 0 END step_ok, CASE WHEN step_action = 'swipe' OR (type_ok = 1 AND fo) THEN 1 ELSE 0 END acc FROM m2)"""


@query(f"""WITH {T_SQL} SELECT trace_id, step_id, coalesce(array_to_string(list(step_action) OVER (PARTITION BY trace_id ORDER BY step_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ','), '') history FROM t""")
def history_prefix(spark, d):
    """All earlier actions of the episode."""
    return H.with_history(steps(spark, d, "step_action"), "trace_id", "step_id", ["step_action"]).select("trace_id", "step_id", F.array_join("prev_step_action", ",").alias("history"))


@query(f"""WITH {T_SQL} SELECT trace_id, step_id, coalesce(array_to_string(list(instr) OVER (PARTITION BY trace_id ORDER BY step_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), chr(10)), '') history FROM t""")
def history_last3(spark, d):
    """The three instructions before the step."""
    return H.with_history(steps(spark, d, "instr"), "trace_id", "step_id", ["instr"], last=3).select("trace_id", "step_id", F.array_join("prev_instr", "\n").alias("history"))


@query(f"""WITH {T_SQL} SELECT trace_id, step_id, row_number() OVER (PARTITION BY trace_id ORDER BY step_id) - 1 step_no, lead(instr) OVER (PARTITION BY trace_id ORDER BY step_id) next_instr FROM t""")
def step_index(spark, d):
    """The number of each step and the instruction that follows."""
    s = H.numbered_steps(steps(spark, d, "instr"), "trace_id", "step_id")
    return H.following(s, "trace_id", "step_id", "instr", "next_instr").select("trace_id", "step_id", F.col("step_no").cast("bigint").alias("step_no"), "next_instr")


@query(f"""WITH {T_SQL}, b AS (SELECT trace_id, step_id, sum(length(instr)) OVER (PARTITION BY trace_id ORDER BY step_id DESC ROWS UNBOUNDED PRECEDING) s FROM t) SELECT trace_id, step_id FROM b WHERE s < 200""")
def history_budget(spark, d):
    """The newest steps of each episode whose instructions fit into 200 characters."""
    return H.within_budget(steps(spark, d, "instr"), "trace_id", "step_id", F.length("instr"), 200).select("trace_id", "step_id")


@query(f"""WITH {T_SQL} SELECT trace_id, step_id, ['UNKNOWN', 'BUTTON', 'CHECKBOX', 'CHECKEDTEXTVIEW', 'EDITTEXT', 'IMAGEBUTTON', 'IMAGEVIEW', 'RADIOBUTTON', 'SLIDINGDRAWER', 'SPINNER', 'SWITCH', 'TABWIDGET', 'TEXTVIEW', 'TOGGLEBUTTON', 'VIDEOVIEW'][ui_pos_obj_type + 1] object_type, CASE step_action
WHEN 'click' THEN '{{"action_type": "click", "target": (' || CAST(CAST(floor((box[1] + box[3]) / 2 * 100) AS INT) AS VARCHAR) || ',' || CAST(CAST(floor((box[2] + box[4]) / 2 * 100) AS INT) AS VARCHAR) || ')}}'
WHEN 'type' THEN '{{"action_type": "input_text", "text": "' || coalesce(ui_pos_obj_input_str, '') || '"}}' WHEN 'swipe' THEN '{{"action_type": "swipe"}}' END action FROM t""")
def action_texts(spark, d):
    """Each step's action as training text, and the name of its object's type."""
    middle = F.transform(F.when(F.col("box").isNotNull(), G.centre(F.col("box"))), lambda x: x * 100)
    text = X.action_text(F.col("step_action"), middle, F.col("ui_pos_obj_input_str"))
    return steps(spark, d, "step_action", "box", "ui_pos_obj_type", "ui_pos_obj_input_str").select("trace_id", "step_id", X.object_type(F.col("ui_pos_obj_type")).alias("object_type"), text.alias("action"))


@query(f"WITH {M_SQL} SELECT trace_id, step_id, type_ok, step_ok FROM m")
def action_match(spark, d):
    """Whether the type and the whole action of each step match the prediction."""
    return scored(spark, d).select("trace_id", "step_id", "type_ok", "step_ok")


@query(f"WITH {M_SQL} SELECT coalesce(scenario, 'average') scenario, round(avg(step_ok), 6) step_sr, round(avg(type_ok), 6) type_acc, count(*) n FROM m GROUP BY GROUPING SETS ((), (scenario))")
def step_sr_by_scenario(spark, d):
    """Step success and type accuracy by scenario and on average."""
    out = scored(spark, d).groupingSets([[], ["scenario"]], "scenario")
    out = out.agg(F.round(F.avg("step_ok"), 6).alias("step_sr"), F.round(F.avg("type_ok"), 6).alias("type_acc"), F.count("*").alias("n"))
    return out.withColumn("scenario", F.coalesce("scenario", F.lit("average")))


@query(f"WITH {M_SQL} SELECT {', '.join(f'''round(sum(CASE WHEN step_action = '{a}' THEN step_ok END) / count(*) FILTER (WHERE step_action = '{a}'), 6) {a}_acc''' for a in ('click', 'type', 'swipe'))} FROM m")
def action_type_acc(spark, d):
    """Accuracy of each action type, side by side."""
    s = scored(spark, d)
    return s.agg(*(F.round(F.sum(F.when(F.col("step_action") == a, F.col("step_ok"))) / F.count_if(F.col("step_action") == a), 6).alias(f"{a}_acc") for a in ("click", "type", "swipe")))


@query(f"""WITH {M_SQL}, e AS (SELECT trace_id, min(acc) ok, avg(acc) part, count(*) n FROM m GROUP BY trace_id)
SELECT round(avg(ok), 6) complete, round(avg(part), 6) partial, round(sum(part * n) / sum(n), 6) micro, (SELECT round(avg(acc), 6) FROM m WHERE step_action <> 'swipe') no_swipe, count(*) episodes FROM e""")
def episode_success(spark, d):
    """Complete episodes, mean share of right steps, share of right steps with and without swipes."""
    s = scored(spark, d)
    e = s.groupBy("trace_id").agg(F.min("acc").alias("ok"), F.avg("acc").alias("part"), F.count("*").alias("n"), F.sum(F.when(F.col("step_action") != "swipe", F.col("acc"))).alias("plain"), F.count_if(F.col("step_action") != "swipe").alias("n_plain"))
    return e.agg(
        F.round(F.avg("ok"), 6).alias("complete"), F.round(F.avg("part"), 6).alias("partial"), F.round(F.sum(F.col("part") * F.col("n")) / F.sum("n"), 6).alias("micro"),
        F.round(F.sum("plain") / F.sum("n_plain"), 6).alias("no_swipe"), F.count("*").alias("episodes"),
    )


@query(f"""WITH {T_SQL}, o AS (SELECT a.trace_id, a.step_id, count(*) n FROM t a JOIN t b ON a.trace_id = b.trace_id AND a.step_id <> b.step_id
AND (a.box[1] + a.box[3]) / 2 BETWEEN b.box[1] AND b.box[3] AND (a.box[2] + a.box[4]) / 2 BETWEEN b.box[2] AND b.box[4] GROUP BY ALL) SELECT * FROM o""")
def taps_in_other_boxes(spark, d):
    """Steps whose middle lies in boxes of other steps of the episode, and in how many."""
    s = steps(spark, d, "box").where("box IS NOT NULL").select("trace_id", "step_id", "box")
    # A box is listed in every cell that it covers and a point in its one cell, so that steps of a trace that are far apart never meet.
    cell = lambda x: F.floor(x * CELLS).cast("int")
    span = lambda a, b: F.when(cell(a) <= cell(b), F.sequence(cell(a), cell(b)))
    b = F.col("box")
    boxes = s.select("trace_id", F.col("step_id").alias("other"), b.alias("other_box"), F.explode(span(G.at(b, 0), G.at(b, 2))).alias("cx"))
    boxes = boxes.select("*", F.explode(span(G.at(F.col("other_box"), 1), G.at(F.col("other_box"), 3))).alias("cy"))
    points = s.withColumn("point", G.centre(b)).select("trace_id", "step_id", "point", cell(G.at(F.col("point"), 0)).alias("cx"), cell(G.at(F.col("point"), 1)).alias("cy"))
    both = points.join(boxes, ["trace_id", "cx", "cy"]).where("step_id <> other")
    return both.where(G.inside(F.col("point"), F.col("other_box"))).groupBy("trace_id", "step_id").agg(F.count("*").alias("n"))


@query(f"""WITH {T_SQL}, w AS (SELECT trace_id, step_id, len(string_split(instr, ' ')) n FROM t), x AS (SELECT *, CASE WHEN n > 5 THEN CAST(ceil((n - 5) / 4.0) AS INT) ELSE 0 END k FROM w),
y AS (SELECT trace_id, step_id, n, unnest(range(0, k + 1)) i FROM x)
SELECT trace_id, step_id, CASE WHEN i = 0 THEN 0 ELSE 5 + (i - 1) * 4 END "start", CASE WHEN i = 0 THEN least(n, 5) ELSE least(n, 5 + i * 4) END stop FROM y""")
def rolling_windows(spark, d):
    """Windows of five words over each instruction, with two words of context."""
    windows = H.rolling_windows(F.split("instr", " "), 5, 2)
    s = steps(spark, d, "instr").select("trace_id", "step_id", F.explode(windows).alias("w"))
    return s.select("trace_id", "step_id", F.col("w.start").cast("bigint").alias("start"), F.col("w.stop").cast("bigint").alias("stop"))


@query(f"""WITH {T_SQL} SELECT trace_id, step_id, CASE ui_pos_obj_type WHEN 0 THEN 'swipe' WHEN 1 THEN 'swipe' WHEN 8 THEN 'swipe' WHEN 9 THEN 'swipe' WHEN 3 THEN 'input_text' WHEN 4 THEN 'click' WHEN 5 THEN 'navigate_back'
WHEN 6 THEN 'navigate_home' WHEN 7 THEN 'enter' WHEN 10 THEN 'status' WHEN 11 THEN 'status' END action_type, CASE ui_pos_obj_type WHEN 0 THEN 'up' WHEN 1 THEN 'down' WHEN 8 THEN 'right' WHEN 9 THEN 'left' END direction FROM t""")
def action_ids(spark, d):
    """Numeric action ids as types and directions; an unknown id gives null."""
    s = steps(spark, d, "ui_pos_obj_type").withColumn("a", X.action_of_id(F.col("ui_pos_obj_type")))
    return s.select("trace_id", "step_id", "a.action_type", "a.direction")
