"""Agent actions in all formats, task prompts, result tables and the declared tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomscope.functions import actions as X
from loomscope.functions import geometry as G
from loomscope.functions import parse as P
from loomscope.functions import text as T
from loomscope.operators import aggregates as A
from loomscope.operators import curate as C
from loomscope.operators import history as H
from loomscope.operators import report
from loomscope.operators import scoring as S
from loomscope.plans import catalogue, tasks
from loomscope.queries import choices, grounding
from loomscope.queries.episodes import T_SQL, steps
from loomscope.queries.grounding import R_SQL, S_SQL
from loomscope.queries.registry import query
from loomscope.session import table, written


def labelled(spark, d):
    """Steps as labelled actions (their object type serves as number), and the step before as a prediction of numbers."""
    s = steps(spark, d, "step_action", "box", "instr", "ui_pos_obj_type", "ui_pos_obj_input_str")
    middle = F.when(F.col("box").isNotNull(), G.centre(F.col("box")))
    gold = X.action_of_row(F.col("ui_pos_obj_type"), F.col("step_action"), middle, F.col("instr"), F.col("ui_pos_obj_input_str"))
    predicted = X.action_of_id(F.col("ui_pos_obj_type"), middle, F.col("ui_pos_obj_input_str"))
    return H.following(s.withColumns({"gold": gold, "own": predicted}), "trace_id", "step_id", "gold", "next_gold")


L_SQL = f"""{T_SQL},
l0 AS (SELECT *, ui_pos_obj_type k, [(box[2] + box[4]) / 2, (box[1] + box[3]) / 2] yx, list_filter(string_split_regex(instr, '\\s+'), lambda w: w <> '')[-1] lastw FROM t),
l1 AS (SELECT *, CASE WHEN k = 4 AND step_action = 'click' THEN 'click' WHEN k = 4 THEN 'swipe' WHEN k = 3 THEN 'input_text' WHEN k = 5 THEN 'navigate_back' WHEN k = 6 THEN 'navigate_home' WHEN k = 7 THEN 'enter' WHEN k IN (10, 11) THEN 'status' END gk,
  CASE WHEN k = 4 THEN 'click' WHEN k IN (0, 1, 8, 9) THEN 'swipe' WHEN k = 3 THEN 'input_text' WHEN k = 5 THEN 'navigate_back' WHEN k = 6 THEN 'navigate_home' WHEN k = 7 THEN 'enter' WHEN k IN (10, 11) THEN 'status' END ok FROM l0),
l AS (SELECT trace_id, step_id, box, gk, CASE WHEN gk = 'click' THEN yx END gt, CASE WHEN gk = 'swipe' THEN lastw END gd, CASE WHEN gk = 'input_text' THEN ui_pos_obj_input_str END gx, CASE WHEN gk = 'status' THEN CASE k WHEN 10 THEN 'successful' ELSE 'infeasible' END END gs,
  ok, CASE WHEN ok = 'click' THEN yx END ot, CASE WHEN ok = 'swipe' THEN CASE k WHEN 0 THEN 'up' WHEN 1 THEN 'down' WHEN 8 THEN 'right' ELSE 'left' END END od, CASE WHEN ok = 'input_text' THEN lower(ui_pos_obj_input_str) END ox, CASE WHEN ok = 'status' THEN CASE k WHEN 10 THEN 'successful' ELSE 'infeasible' END END os FROM l1)"""


@query(f"WITH {L_SQL} SELECT trace_id, step_id, gk gold_type, round(gt[1], 6) gold_y, gd gold_direction, gx gold_text, gs gold_status, ok own_type, round(ot[2], 6) own_x, od own_direction, ox own_text, os own_status FROM l")
def agent_formats(spark, d):
    """Each step as a labelled and as a predicted action, with all members."""
    s = labelled(spark, d)
    return s.select(
        "trace_id", "step_id", F.col("gold.action_type").alias("gold_type"), F.round(F.col("gold.target")[0], 6).alias("gold_y"), F.col("gold.direction").alias("gold_direction"), F.col("gold.text").alias("gold_text"), F.col("gold.goal_status").alias("gold_status"),
        F.col("own.action_type").alias("own_type"), F.round(F.col("own.target")[1], 6).alias("own_x"), F.col("own.direction").alias("own_direction"), F.col("own.text").alias("own_text"), F.col("own.goal_status").alias("own_status"),
    )


_KINDS = (("click_acc", "gk = 'click'"), ("text_acc", "gk = 'input_text'"), ("swipe_acc", "gk = 'swipe'"), ("enter_acc", "gk = 'enter'"), ("home_acc", "gk = 'navigate_home'"), ("back_acc", "gk = 'navigate_back'"), ("complete_acc", "gs = 'successful'"), ("infeasible_acc", "gs = 'infeasible'"))


@query(f"""WITH {L_SQL}, p AS (SELECT *, lag(ok) OVER w pk, lag(ot) OVER w pt, lag(od) OVER w pd, lag(ox) OVER w px, lag(os) OVER w ps FROM l WINDOW w AS (PARTITION BY trace_id ORDER BY step_id)),
q AS (SELECT *, box[1] - (box[3] - box[1]) * 0.7 x1, box[3] + (box[3] - box[1]) * 0.7 x2, box[2] - (box[4] - box[2]) * 0.7 y1, box[4] + (box[4] - box[2]) * 0.7 y2 FROM p),
m AS (SELECT *, CASE WHEN gk = pk THEN CASE gk WHEN 'click' THEN coalesce(gt[2] BETWEEN greatest(0.0, x1) AND least(1.0, x2) AND gt[1] BETWEEN greatest(0.0, y1) AND least(1.0, y2) AND pt[2] BETWEEN greatest(0.0, x1) AND least(1.0, x2) AND pt[1] BETWEEN greatest(0.0, y1) AND least(1.0, y2), false) OR coalesce(sqrt(power(gt[1] - pt[1], 2) + power(gt[2] - pt[2], 2)) <= 0.14, false)
  WHEN 'input_text' THEN contains(lower(coalesce(gx, '')), lower(coalesce(px, ''))) OR contains(lower(coalesce(px, '')), lower(coalesce(gx, ''))) WHEN 'swipe' THEN gd IS NOT DISTINCT FROM pd WHEN 'status' THEN gs IS NOT DISTINCT FROM ps ELSE true END ELSE false END ok2 FROM q)
SELECT {", ".join(f"coalesce(round(CAST(count(*) FILTER (WHERE {c} AND ok2) AS DOUBLE) / nullif(count(*) FILTER (WHERE {c}), 0), 6), 0.0) {n}" for n, c in _KINDS)}, count(*) FILTER (WHERE gk IS NULL) unknown FROM m""")
def agent_accuracy_by_kind(spark, d):
    """Accuracy over the labelled actions of each of eight kinds, where the prediction repeats the step before."""
    s = H.numbered_steps(labelled(spark, d), "trace_id", "step_id")
    before = s.select(F.col("trace_id").alias("t"), (F.col("step_no") + 1).alias("n"), F.col("own").alias("before"))
    both = s.join(before, (F.col("trace_id") == F.col("t")) & (F.col("step_no") == F.col("n")), "left")
    _, full = X.formats_match(F.col("gold"), F.col("before"), F.array("box"))
    both = both.withColumn("ok", F.coalesce(full, F.lit(False)))
    return both.agg(*X.accuracy_by_kind(F.col("gold"), F.col("ok")), F.count_if(F.col("gold.action_type").isNull()).alias("unknown"))


@query(r"""WITH e AS (SELECT DISTINCT response_id, response FROM eval_responses), x AS (SELECT *, regexp_extract(response, '(\{"[^{]*\})', 1) j FROM e WHERE regexp_matches(response, '^[^{]*\{"[^{]*\}')),
y AS (SELECT response_id, regexp_extract(j, '"action_type": ?"([a-z_]+)"', 1) k, regexp_extract(j, '"target": ?[\[(]\s*([0-9.]+)\s*,\s*([0-9.]+)\s*[\])]', ['a', 'b']) t FROM x)
SELECT response_id, k action_type, round(CASE WHEN k = 'click' THEN TRY_CAST(t.b AS DOUBLE) / 100 END, 6) y, round(CASE WHEN k = 'click' THEN TRY_CAST(t.a AS DOUBLE) / 100 END, 6) x FROM y WHERE k <> ''""")
def response_actions(spark, d):
    """Responses that hold an action with members, its target as (y, x) in parts of one."""
    e = table(spark, d, "eval_responses").select("response_id", "response").distinct().where(F.col("response").contains('{"'))
    a = e.withColumn("a", X.action_of_fields(P.action_fields(F.col("response")), 100.0)).where("a.action_type IS NOT NULL")
    return a.select("response_id", "a.action_type", F.round(F.col("a.target")[0], 6).alias("y"), F.round(F.col("a.target")[1], 6).alias("x"))


@query(r"""WITH e AS (SELECT DISTINCT response_id, coalesce(response, '') r FROM eval_responses),
x AS (SELECT response_id, r, regexp_extract(r, '"action_type": "([a-z_]*)"', 1) k, string_split(regexp_extract(r, '"target": \(([0-9., ]*)\)', 1), ',') b, string_split(nullif(regexp_extract(r, '\[\[(\d+,\d+(,\d+,\d+)?)\]\]', 1), ''), ',') g FROM e),
y AS (SELECT *, CASE WHEN len(g) IN (2, 4) AND r NOT LIKE '%tap%' AND r NOT LIKE '%Grounded%' THEN list_transform(g, lambda v: CAST(v AS DOUBLE) / 1000) END q FROM x)
SELECT response_id, CASE WHEN contains(k, 'click') AND len(b) = 2 THEN 'click' ELSE 'swipe' END named, CASE WHEN r LIKE '{%}' AND contains(k, 'click') AND len(b) = 2 THEN 'click' ELSE 'swipe' END numbered,
CASE WHEN q IS NOT NULL THEN 'click' ELSE 'swipe' END grounded, CASE WHEN q IS NOT NULL THEN round(list_avg(q), 6) ELSE 0.5 END middle FROM y""")
def element_actions(spark, d):
    """Responses read as actions on elements in all dialects."""
    e = table(spark, d, "eval_responses").select("response_id", "response").distinct()
    r = F.coalesce("response", F.lit(""))
    named = F.replace(F.regexp_replace(r, r"\(([\d., ]*)\)", "[$1]"), F.lit('"target"'), F.lit('"bbox"'))
    numbered = F.replace(F.replace(r, F.lit('"click"'), F.lit("4")), F.lit('"target"'), F.lit('"click_point"'))
    # a response's double brackets as the operation of a sentence
    grounded = F.concat(F.lit("Plan: none. Grounded Operation:"), F.when(r.contains("[[") & ~r.contains("tap") & ~r.contains("Grounded"), F.concat(F.lit("tap "), r)).otherwise(""))
    e = e.select("response_id", *(X.element_action(c, k).alias(k) for c, k in ((named, "named"), (numbered, "numbered"), (grounded, "grounded"))))
    middle = F.aggregate("grounded.box", F.lit(0.0), lambda a, x: a + x) / F.size("grounded.box")
    return e.select("response_id", *(F.col(f"{k}.action_type").alias(k) for k in ("named", "numbered", "grounded")), F.round(middle, 6).alias("middle"))


MODELS = ("GPT-4o", "llava-1.6", "llava-v1.5", "llama3", "uipro", "MiniCPM", "deepseek-vl", "cogagent", "qwen2-vl", "slime", "monkey", "seeclick", "paligemma", "other")
_AX = "Output the normalized X and Y coordinates, ranging from 0.00 to 1.00. Note that the X-axis runs horizontally from left (0.00) to right (1.00), and the Y-axis runs vertically from top (0.00) to bottom (1.00). Your should carefully view the image before finally predicting the required"
_PT = f"""'In this UI screenshot, what is the position of the element corresponding to the description "' || f || '"? {_AX} position in the format [X, Y] (two decimal places). Your answer MUST only include the coordiniates withou any explanations.'"""
_BX = f"""'In this UI screenshot, what are the bounding box coordinates of the element corresponding to the command "' || f || '"? {_AX} bounding box coordinates in the format [X_topleft, Y_topleft, X_bottomright, Y_bottomright]. Your answer MUST only include the coordiniates withou any explanations.'"""
_FB = """'What are the bounding box coordinates of the element corresponding to the functionality "' || f || '" in this UI screenshot?'"""
_WEB = """CASE rec_id % 4 WHEN 0 THEN 'In the screenshot of this web page, please give me the coordinates of the element I want to click on according to my instructions (with point).'
WHEN 1 THEN 'Based on the screenshot of the page, I give a text description and you give its corresponding location (with point).'
WHEN 2 THEN 'In the image above, I will give a series of descriptions of the element to be clicked. Please predict where you want to click (with point).'
ELSE 'I will give textual descriptions of a certain element in the screenshot. Please predict the location of the corresponding element (with point).' END"""


@query(f"""WITH r AS (SELECT DISTINCT rec_id, func, trim(func, '.') f FROM func_records WHERE func IS NOT NULL)
SELECT rec_id, md5(CASE rec_id % 14 WHEN 0 THEN {_PT} WHEN 1 THEN '[INST] <image>' || {_PT} || ' [/INST]' WHEN 2 THEN 'USER: <image>' || {_PT} || chr(10) || 'ASSISTANT:' WHEN 3 THEN {_BX}
WHEN 4 THEN {_WEB} || ' ' || f WHEN 5 THEN {_FB} WHEN 6 THEN '<image_placeholder>' || {_PT} WHEN 7 THEN 'Can you point out the element specified by the command ' || f || ' in the UI screenshot and provide the bounding box of its location?'
WHEN 8 THEN {_BX.replace("from 0.00 to 1.00", "from 0 to 1000").replace("(0.00)", "(0)").replace("(1.00)", "(999)")} WHEN 9 THEN {_PT} WHEN 10 THEN {_FB}
WHEN 11 THEN 'In this UI screenshot, what is the position of the element corresponding to the command "' || f || '" (with point)?' WHEN 12 THEN 'detect the region targeted by the command "' || f || '"'
ELSE {_WEB} || CASE WHEN starts_with(func, 'This element') THEN ' ' || f ELSE ' This element is used for "' || f || '"' END END) prompt FROM r""")
def prompts_by_family(spark, d):
    """The hash of each record's prompt in the form of a model's family; each record asks one of fourteen models."""
    r = table(spark, d, "func_records").select("rec_id", "func").distinct().where("func IS NOT NULL")
    model = F.element_at(F.array(*(F.lit(m) for m in MODELS)), (F.col("rec_id") % len(MODELS) + 1).cast("int"))
    return r.select("rec_id", F.md5(C.prompt_for(model, F.col("func"), F.col("rec_id"))).alias("prompt"))


@query(f"""WITH {R_SQL} SELECT rec_id, 'Locate: ' || trim(func, ' .') || '. (center)' goal,
'Direct a user to interact with the highlighted region [' || printf('%.2f', box[1]) || ', ' || printf('%.2f', box[2]) || ', ' || printf('%.2f', box[3]) || ', ' || printf('%.2f', box[4]) || '].' region,
'Answer the question using a single word or phrase.' || chr(10) || elem_text question FROM r""")
def task_prompts(spark, d):
    """Prompts that locate an element, ask for a region's instruction, and ask a question."""
    r = grounding.records(spark, d, "func", "elem_text")
    return r.select("rec_id", C.goal_prompt("Locate: ", "{goal_info} (center)", F.col("func")).alias("goal"), C.region_prompt(F.col("box")).alias("region"), C.question_prompt(F.col("elem_text")).alias("question"))


@query("""WITH v AS (SELECT DISTINCT sample_id, image, conversations cv FROM train_samples WHERE len(conversations) > 1),
m AS (SELECT sample_id, image, i, CASE cv[i].sender WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE cv[i].sender END "role", trim(replace(cv[i].content, '<image>', ''), ' ' || chr(10) || chr(9)) c, coalesce(cv[i + 1].content, '') a FROM (SELECT *, unnest(range(1, len(cv) + 1)) i FROM v)),
n AS (SELECT sample_id, i, CASE WHEN i = 1 THEN 'Picture 1: <img>' || image || '</img>' || chr(10) ELSE '' END || CASE WHEN "role" = 'user' AND ((NOT starts_with(a, '(') AND NOT ends_with(a, ')')) OR length(a) >= 8) AND instr(c, '(') > 0 THEN substr(c, 1, instr(c, '(') - 1) || '<ref>' || substr(c, instr(c, '(')) ELSE c END t FROM m)
SELECT sample_id, i - 1 turn, md5(t) content, md5(replace(replace(t, '<ref>', ''), '</ref>', '')) bare FROM n""")
def grounding_messages(spark, d):
    """Hashes of the messages rewritten as grounding data, and of the same without ref tags."""
    s = table(spark, d, "train_samples").where("size(conversations) > 1").select("sample_id", "image", "conversations").dropDuplicates(["sample_id"])
    m = s.select("sample_id", C.rewritten(C.chat(F.col("conversations")), F.col("image")).alias("m"))
    both = F.arrays_zip("m", C.without_ref_tags(F.col("m")).alias("bare"))
    x = m.select("sample_id", F.posexplode(both).alias("turn", "x"))
    return x.select("sample_id", F.col("turn").cast("bigint").alias("turn"), F.md5("x.m.content").alias("content"), F.md5("x.bare.content").alias("bare"))


@query(f"""WITH {S_SQL}, v AS (SELECT model task, 'center_acc' metric, CAST(hit AS DOUBLE) v FROM s UNION ALL SELECT model, 'center_dist', dist FROM s WHERE dist IS NOT NULL),
a AS (SELECT task, metric, avg(v) m, stddev_samp(v) / sqrt(count(v)) se FROM v GROUP BY ALL)
SELECT task "Tasks", CAST(length(task) AS BIGINT) "Version", 'none' "Filter", '0' n_shot, metric "Metric", printf('%.2f', CASE WHEN m BETWEEN 0 AND 1 THEN m * 100 ELSE m END) "Value", CASE WHEN se IS NULL THEN '' ELSE '±' END "Sign", CASE WHEN se IS NULL THEN '' ELSE printf('%.3f', se) END "Stderr" FROM a""")
def result_table(spark, d):
    """The result table as it is shown (its numbers with fewer decimals)."""
    s = grounding.scored(spark, d).select(F.col("model").alias("task"), F.col("hit").cast("double").alias("center_acc"), F.col("dist").alias("center_dist"))
    out = report.results(report.long(s, ["task"], ["center_acc", "center_dist"]))
    rows = report.result_rows(out, out.select("task", F.length("task").cast("bigint").alias("version"), F.lit(0).alias("n_shot")).distinct())
    short = lambda c, n: F.when(F.col(c).try_cast("double").isNotNull(), F.format_string(f"%.{n}f", F.col(c).try_cast("double"))).otherwise(F.col(c))
    return rows.withColumns({"Value": short("Value", 2), "Stderr": short("Stderr", 3)})


@query("""WITH m AS (SELECT DISTINCT NULL::VARCHAR parent, source "name" FROM func_records WHERE source IS NOT NULL UNION SELECT DISTINCT source, source || '/' || split FROM func_records WHERE source IS NOT NULL AND split IS NOT NULL),
t AS (SELECT "name", [CAST("name" AS VARCHAR)] path, 0 depth FROM m WHERE parent IS NULL UNION ALL SELECT m."name", [m.parent, m."name"], 1 FROM m WHERE parent IS NOT NULL)
SELECT row_number() OVER (ORDER BY path) - 1 "position", depth, "name", CASE WHEN depth > 0 THEN ' - ' || "name" ELSE "name" END shown FROM t""")
def task_hierarchy(spark, d):
    """Sources and their splits as groups and tasks, in the order and with the indentation that they are shown in."""
    r = table(spark, d, "func_records").where("source IS NOT NULL").select("source", "split").distinct()
    top = r.select(F.lit(None).cast("string").alias("parent"), F.col("source").alias("name")).distinct()
    below = r.where("split IS NOT NULL").select(F.col("source").alias("parent"), F.concat_ws("/", "source", "split").alias("name"))
    out = report.hierarchy(top.union(below))
    return out.select(F.col("position").cast("bigint").alias("position"), "depth", "name", "shown")


@query(f"""WITH {S_SQL}, n AS (SELECT response_id, hit FROM s) SELECT CAST(e.response_id AS VARCHAR) id, e.prompt "data", length(e.prompt) input_len, CAST(e.rec_id AS VARCHAR) labels, 'generate_until' output_type, e.response raw_predictions, trim(lower(e.response)) filtered_predictions, n.hit
FROM (SELECT DISTINCT response_id, rec_id, prompt, response FROM eval_responses) e JOIN n USING (response_id)""")
def sample_frame(spark, d):
    """One row a sample as trackers show it."""
    e = table(spark, d, "eval_responses").select("response_id", "rec_id", "prompt", "response").distinct()
    e = e.join(grounding.scored(spark, d).select("response_id", "hit"), "response_id").withColumn("filtered", F.trim(F.lower("response")))
    return report.sample_frame(e, "response_id", "prompt", "rec_id", "response", "filtered", ["hit"])


@query("""WITH r AS (SELECT DISTINCT rec_id, split, source FROM func_records) SELECT source task, split, count(*) n, replace(source || ',none', ',none', '') plain, source || '@' metric, CASE WHEN split IS NULL THEN '' ELSE split END "filter" FROM r GROUP BY source, split""")
def task_counts(spark, d):
    """Documents of each task and split, and its name out of a key of metric and filter."""
    r = table(spark, d, "func_records").select("rec_id", "split", "source").distinct().groupBy(F.col("source").alias("task"), "split").agg(F.count("*").alias("n"))
    key = report.split_key(F.concat(F.col("task"), F.lit("@,"), F.coalesce("split", F.lit(""))))
    return r.select("task", "split", "n", report.metric_name(F.concat("task", F.lit(",none"))).alias("plain"), key["metric"].alias("metric"), key["filter"].alias("filter"))


@query(f"""WITH {choices.C_SQL}, q AS (SELECT label, vec_id // 3 % 7 question, bool_and((p = gold) OR label > 6) ok FROM c GROUP BY ALL), o AS (SELECT CASE WHEN ok THEN 1.0 ELSE 0.0 END ok FROM q)
SELECT round(avg(ok), 6) acc_all, round(stddev_samp(ok) / sqrt(count(*)), 6) acc_all_stderr FROM o""")
def all_answers_stderr(spark, d):
    """Questions of which every answer is right, with the standard error."""
    c = choices.docs(spark, d).withColumns({"question": F.floor(F.col("vec_id") / 3) % 7, "ok": (S.argmax(F.col("lls")) == F.col("gold")) | (F.col("label") > 6)})
    mean, error = (f(c, ["label", "question"], F.lit(True), F.col("ok")) for f in (A.all_correct, A.all_correct_stderr))
    return mean.join(F.broadcast(error)).select(F.round("acc_all", 6).alias("acc_all"), F.round("acc_all_stderr", 6).alias("acc_all_stderr"))  # one row each


@query(r"""WITH r AS (SELECT DISTINCT rec_id, unnormalized_box b, image_size, point p FROM func_records), x AS (SELECT *, TRY_CAST(split_part(image_size, 'x', 1) AS DOUBLE) w FROM r)
SELECT rec_id, CASE WHEN len(b) = 4 THEN CAST(floor(b[3]) AS INT) END x2, round(b[3] / w, 6) right_part, round(CASE WHEN len(p) = 2 THEN p[2] / 999.0 ELSE 0.0 END, 6) loc_y FROM x WHERE b IS NOT NULL AND len(list_filter(b, lambda v: v IS NULL)) = 0""")
def other_notations(spark, d):
    """Boxes written as text and read again, pixels in parts of the picture, and points as location tokens."""
    r = table(spark, d, "func_records").select("rec_id", F.col("unnormalized_box").alias("b"), "image_size", "point").distinct().where("b IS NOT NULL AND NOT exists(b, x -> x IS NULL)")
    text = F.concat(F.lit("["), F.array_join(F.transform("b", lambda x: F.floor(x).cast("string")), ", "), F.lit("]"))
    w, h = G.size_of(F.col("image_size"))
    tokens = F.when(F.size("point") == 2, F.array_join(F.transform("point", lambda x: F.concat(F.lit("<loc_"), x.cast("string"), F.lit(">"))), "")).otherwise("")
    return r.select("rec_id", G.at(P.box_text_numbers(text), 2).alias("x2"), F.round(G.at(P.scaled_to(F.col("b"), F.lit(-1), w, h), 2), 6).alias("right_part"), F.round(G.at(P.loc_tokens(tokens, count=2), 1), 6).alias("loc_y"))


@query(r"""WITH r AS (SELECT DISTINCT rec_id, source, split, elem_tag FROM func_records WHERE source IS NOT NULL AND split IS NOT NULL)
SELECT rec_id, source || ';' || split AS second, CASE WHEN rec_id % 2 = 0 THEN 'true' ELSE CAST(rec_id AS VARCHAR) END v, CASE WHEN rec_id % 2 = 0 THEN 'bool' ELSE 'int' END kind FROM r""")
def parsed_arguments(spark, d):
    """Texts split where the separator is not escaped, and arguments with their kinds."""
    r = table(spark, d, "func_records").select("rec_id", "source", "split").distinct().where("source IS NOT NULL AND split IS NOT NULL")
    parts = T.escaped_split(F.concat(F.lit("a;"), "source", F.lit("\\;"), "split", F.lit(";b")), ";")
    even = F.col("rec_id") % 2 == 0
    known = T.argument_map(F.concat(F.lit("x = 1.5,k="), F.when(even, "true").otherwise(F.col("rec_id").cast("string")), F.lit(",s=text")))
    return r.select("rec_id", F.element_at(parts, 2).alias("second"), known["k"]["value"].alias("v"), known["k"]["kind"].alias("kind"))


TIDY = r"lower(regexp_replace({}, '[!-/:-@\[-`{{-~]', '', 'g'))"


@query(rf"""WITH r AS (SELECT DISTINCT rec_id, elem_text, elem_role FROM func_records WHERE elem_text IS NOT NULL AND elem_role IS NOT NULL),
x AS (SELECT 'none' f, {TIDY.format("elem_text")} = {TIDY.format("elem_role")} ok FROM r UNION ALL SELECT 'last_word', {TIDY.format("coalesce(regexp_extract_all(elem_text, '[A-Za-z]+')[-1], '[invalid]')")} = {TIDY.format("elem_role")} FROM r)
SELECT 'role_named' task, 'exact' metric, f "filter", round(avg(ok::INT), 6) shown, round(stddev_samp(ok::INT) / sqrt(count(*)), 6) stderr, count(*) n FROM x GROUP BY f""")
def task_pipelines(spark, d):
    """A task whose answers are scored under two filter pipelines: whether a caption, or its last word, is the element's role."""
    r = table(spark, d, "func_records").select("rec_id", "elem_text", "elem_role").distinct().where("elem_text IS NOT NULL AND elem_role IS NOT NULL")
    last = (("regex", {"pattern": "[A-Za-z]+", "group_select": -1}), ("take_first", {}))
    task = tasks.Task("role_named", "{{elem_text}}", "elem_role", metrics={"exact": "mean"}, pipelines={"none": (("take_first", {}),), "last_word": last})
    out = tasks.evaluate(task, tasks.requests_of(task, r.withColumn("resps", F.array("elem_text"))))
    return out.withColumns({c: F.round(c, 6) for c in ("shown", "stderr")})


RUN = ("func_pred_rec_test", "autoguiv2_funcregion_detect_test", "vwb_ag_test")


@query(f"""WITH {S_SQL}, u AS (SELECT 'func_pred_rec_test' task, 'center_acc' metric, CAST(hit AS DOUBLE) v FROM s WHERE split = 'test' UNION ALL SELECT 'autoguiv2_funcregion_detect_test', 'iou_acc', CASE WHEN iou >= 0.5 THEN 1.0 ELSE 0.0 END FROM i WHERE split = 'val'
UNION ALL SELECT 'vwb_ag_test', 'center_acc', hit FROM s WHERE split = 'test' UNION ALL SELECT 'vwb_ag_test', 'center_dist', dist FROM s WHERE split = 'test'),
a AS (SELECT task, metric, avg(v) m, stddev_samp(v) / sqrt(count(v)) se, count(v) n FROM u GROUP BY ALL), g AS (SELECT metric, sum(m * n) / sum(n) m, CAST(sum(n) AS BIGINT) n FROM a GROUP BY metric)
SELECT task, metric, 'none' "filter", round(m, 6) shown, round(se, 6) stderr, n FROM a UNION ALL SELECT 'grounding', metric, 'none', round(m, 6), NULL, n FROM g""")
def task_results(spark, d):
    """Declared tasks over all responses: prompts, filters, metrics and the means of their group."""
    catalogue.declare()
    docs = table(spark, d, "eval_responses").select("response_id", "rec_id", "model", "response").distinct()
    docs = docs.join(grounding.records(spark, d, "split", "func"), "rec_id").where("box IS NOT NULL")
    docs = docs.withColumns({"scale": F.when(F.col("model") == "grounder_b", 1000).otherwise(100), "goal": F.coalesce("func", F.lit("")), "resps": F.array("response")})
    docs = written(catalogue.with_coords(docs).drop("scale"), "answered")
    out = tasks.evaluate_all(list(RUN), {n: tasks.requests_of(tasks.TASKS[n], docs) for n in RUN})
    return out.withColumns({c: F.round(c, 6) for c in ("shown", "stderr")})
