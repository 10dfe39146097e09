"""Training data: chat formats, unions, shuffles, prompts and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscope.functions.text import stable_hash

# Roles of senders.
ROLES = {"human": "user", "gpt": "assistant"}

# Prompts that ask for an element, as models of each family are asked.
_AXES = " Output the normalized X and Y coordinates, ranging from 0.00 to 1.00. Note that the X-axis runs horizontally from left (0.00) to right (1.00), and the Y-axis runs vertically from top (0.00) to bottom (1.00). Your should carefully view the image before finally predicting the required"
_ONLY = " Your answer MUST only include the coordiniates withou any explanations."
POSITION_PROMPT = 'In this UI screenshot, what is the position of the element corresponding to the description "{}"?' + _AXES + " position in the format [X, Y] (two decimal places)." + _ONLY
BOX_PROMPT = 'In this UI screenshot, what are the bounding box coordinates of the element corresponding to the command "{}"?' + _AXES + " bounding box coordinates in the format [X_topleft, Y_topleft, X_bottomright, Y_bottomright]." + _ONLY
THOUSANDTHS_PROMPT = BOX_PROMPT.replace("from 0.00 to 1.00", "from 0 to 1000").replace("(0.00)", "(0)").replace("(1.00)", "(999)")
FUNCTION_BOX_PROMPT = 'What are the bounding box coordinates of the element corresponding to the functionality "{}" in this UI screenshot?'
COMMAND_BOX_PROMPT = "Can you point out the element specified by the command {} in the UI screenshot and provide the bounding box of its location?"
SEE_POINT_PROMPT = 'In this UI screenshot, what is the position of the element corresponding to the command "{}" (with point)?'
SEE_BOX_PROMPT = 'In this UI screenshot, what is the position of the element corresponding to the command "{}" (with bbox)?'
DETECT_PROMPT = 'detect the region targeted by the command "{}"'
WEB_PROMPTS = (
    "In the screenshot of this web page, please give me the coordinates of the element I want to click on according to my instructions (with point).",
    "Based on the screenshot of the page, I give a text description and you give its corresponding location (with point).",
    "In the image above, I will give a series of descriptions of the element to be clicked. Please predict where you want to click (with point).",
    "I will give textual descriptions of a certain element in the screenshot. Please predict the location of the corresponding element (with point).",
)
#: Families in the order in which their names are looked for in a model's name: names, prompt for a point, prompt for a box.
FAMILIES = (
    (("gpt", "claude"), POSITION_PROMPT, BOX_PROMPT), (("llava-1.6", "llava1.6", "llava-v1.6"), f"[INST] <image>{POSITION_PROMPT} [/INST]", f"[INST] <image>{BOX_PROMPT} [/INST]"),
    (("llava",), f"USER: <image>{POSITION_PROMPT}\nASSISTANT:", f"USER: <image>{BOX_PROMPT}\nASSISTANT:"), (("llama",), BOX_PROMPT, BOX_PROMPT), (("uipro",), None, None), (("minicpm",), FUNCTION_BOX_PROMPT, FUNCTION_BOX_PROMPT),
    (("deepseek",), f"<image_placeholder>{POSITION_PROMPT}", f"<image_placeholder>{BOX_PROMPT}"), (("cogagent",), COMMAND_BOX_PROMPT, COMMAND_BOX_PROMPT), (("qwen2",), THOUSANDTHS_PROMPT, THOUSANDTHS_PROMPT),
    (("qwen", "slime"), POSITION_PROMPT, FUNCTION_BOX_PROMPT), (("monkey",), FUNCTION_BOX_PROMPT, FUNCTION_BOX_PROMPT), (("seeclick",), SEE_POINT_PROMPT, SEE_BOX_PROMPT), (("pali",), DETECT_PROMPT, DETECT_PROMPT),
)
QA_PROMPT = "Answer the question using a single word or phrase."


def chat(conversations: Column) -> Column:
    """Messages as ``role, content``, roles by their common names."""
    roles = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    return F.transform(conversations, lambda m: F.struct(F.coalesce(F.try_element_at(roles, m["sender"]), m["sender"]).alias("role"), m["content"].alias("content")))


def picture_and_text(first: Column) -> Column:
    """The picture path in front of a first message, and the message without it."""
    path = F.nullif(F.regexp_extract(first, "(?s)<img>(.*?)</img>", 1), F.lit(""))
    text = F.when(path.isNotNull(), F.split_part(first, F.lit("</img>"), F.lit(2))).otherwise(F.replace(first, F.lit("<image>"), F.lit("")))
    return F.struct(path.alias("path"), F.trim(text, F.lit("\n")).alias("text"))


def ref_tagged(value: Column, answer: Column) -> Column:
    """A ref tag before the first bracket of a message whose answer is longer than a point or none."""
    at = F.locate("(", value)
    plain = (~answer.startswith("(") & ~answer.endswith(")")) | (F.length(answer) >= 8)
    return F.when(plain & (at > 0), F.concat(F.substring(value, F.lit(1), at - 1), F.lit("<ref>"), F.substring(value, at, F.length(value)))).otherwise(value)


def chatml(messages: Column) -> Column:
    """Messages as one text with start and end marks."""
    one = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>"))
    return F.array_join(F.transform(messages, one), "\n")


def padded(ids: Column, size: int, pad: int) -> Column:
    """An array cut or padded to ``size`` items."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), size)), 1, size)


def masked(messages: Column, size: int, hidden: int = -100) -> tuple[Column, Column]:
    """Word lengths of all messages as ids, and labels that show those of assistants only, both of ``size`` items."""
    lengths = lambda m: F.transform(F.split(F.coalesce(m["content"], F.lit("")), " "), lambda w: F.length(w))
    ids = F.flatten(F.transform(messages, lengths))
    labels = F.flatten(F.transform(messages, lambda m: F.transform(lengths(m), lambda w: F.when(m["role"] == "assistant", w).otherwise(hidden))))
    return padded(ids, size, 0), padded(labels, size, hidden)


def shuffled_key(key: Column, seed: int = 0) -> Column:
    """A hash to order by, the same whatever the partitions."""
    return stable_hash(key, seed)


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows with the least hash of a unique key; each partition keeps only its own best."""
    return rows.orderBy(shuffled_key(F.col(key), seed), key).limit(n)


def union(*frames: DataFrame) -> DataFrame:
    """All rows of several tables; a column that one lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def kept_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each ``key`` by ``order`` (nulls last), of equal ones any; the rows of a key are reduced before they are shuffled."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(F.col(order).isNull(), order)).alias("_first"))
    return best.select(*(F.col(c) if c == key else F.col("_first")[c].alias(c) for c in rows.columns))


def prompt_for(model: Column, instruction: Column, choice: Column, box: bool = False, prompts: tuple[str, ...] = WEB_PROMPTS) -> Column:
    """The prompt of a model's family; the first family whose name occurs in the model's counts, in lower case.

    Models of no family get one of ``prompts``, the one that ``choice`` (a whole number, such as a key's hash) names, and the instruction as the use of the
    element, unless it says so itself.
    """
    text, name = F.trim(instruction, F.lit(".")), F.lower(model)
    fill = lambda t: F.concat(F.lit(t.split("{}")[0]), text, F.lit(t.split("{}")[1]))
    general = F.element_at(F.array(*(F.lit(p.replace("with point", "with bbox") if box else p) for p in prompts)), (F.pmod(choice, F.lit(len(prompts))) + 1).cast("int"))
    plain = F.concat(general, F.lit(" "), text)
    out = F.when(F.lit(False), "")
    for names, point, whole in FAMILIES:
        test = F.lit(False)
        for n in names:
            test = test | name.contains(n)
        template = whole if box else point
        out = out.when(test, fill(template) if template else plain)
    used = F.when(instruction.startswith("This element"), plain).otherwise(F.concat(general, F.lit(' This element is used for "'), text, F.lit('"')))
    return out.otherwise(used)


def goal_prompt(before: str, after: str, goal: Column) -> Column:
    """A task's prompt: ``before`` and ``after`` with the goal in place of ``{goal_info}``, ended by one full stop."""
    ended = F.concat(F.trim(goal, F.lit(" .")), F.lit("."))
    head, tail = after.split("{goal_info}")
    return F.concat(F.lit(before + head), ended, F.lit(tail))


def region_prompt(box: Column) -> Column:
    """The prompt that asks for the instruction which leads to a region."""
    shown = F.array_join(F.transform(box, lambda x: F.format_string("%.2f", x)), ", ")
    return F.when(box.isNotNull(), F.concat(F.lit("Direct a user to interact with the highlighted region ["), shown, F.lit("].")))


def question_prompt(question: Column) -> Column:
    return F.concat(F.lit(QA_PROMPT + "\n"), question)


def rewritten(messages: Column, image: Column) -> Column:
    """Messages (``role, content``) as grounding data: image marks out, a ref tag before the point of a question, the picture in front of the first."""
    bare = lambda t: F.trim(F.replace(t, F.lit("<image>"), F.lit("")), F.lit(" \n\t"))
    following = lambda i: F.coalesce(F.try_element_at(messages, i + 2)["content"], F.lit(""))
    text = lambda m, i: F.when(m["role"] == "user", ref_tagged(bare(m["content"]), following(i))).otherwise(bare(m["content"]))
    front = lambda i: F.when(i == 0, F.concat(F.lit("Picture 1: <img>"), image, F.lit("</img>\n"))).otherwise("")
    return F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.concat(front(i), text(m, i)).alias("content")))


def without_ref_tags(messages: Column) -> Column:
    """Messages without ref tags."""
    bare = lambda t: F.replace(F.replace(t, F.lit("<ref>"), F.lit("")), F.lit("</ref>"), F.lit(""))
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), bare(m["content"]).alias("content")))


def spaced(n: Column, k: int) -> Column:
    """``k`` evenly spaced positions of a sequence of ``n``, the first and the last included."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / (k - 1)).cast("int"))
