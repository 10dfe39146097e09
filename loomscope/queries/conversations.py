"""Conversations as training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomscope.functions import parse as P
from loomscope.operators import curate as C
from loomscope.operators import requests as R
from loomscope.plans import catalogue, tasks
from loomscope.queries.registry import query
from loomscope.session import table


def samples(spark, d):
    """The conversation of each sample; rows of a sample are alike."""
    return table(spark, d, "train_samples").select("sample_id", "conversations").dropDuplicates(["sample_id"]).withColumn("messages", C.chat(F.col("conversations")))


V_SQL = """
v AS (SELECT DISTINCT sample_id, id, image, site, wxh, conversations cv FROM train_samples),
g AS (SELECT *, list_transform(cv, lambda m: {'role': CASE m.sender WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.sender END, 'content': m.content}) messages FROM v),
u AS (SELECT sample_id, site, unnest(range(1, len(messages) + 1)) i, messages FROM g), t AS (SELECT sample_id, site, i - 1 turn, messages[i].role "role", messages[i].content "content", messages[i + 1].content following FROM u)"""


@query(f"WITH {V_SQL} SELECT sample_id, turn, role, content FROM t")
def chat_messages(spark, d):
    """Every message with its role by its common name."""
    m = samples(spark, d).select("sample_id", F.posexplode("messages").alias("turn", "m"))
    return m.select("sample_id", F.col("turn").cast("bigint").alias("turn"), "m.role", "m.content")


@query(f"""WITH {V_SQL}, f AS (SELECT sample_id, turn, content, row_number() OVER (PARTITION BY sample_id ORDER BY turn) k FROM t WHERE role = 'user' AND content IS NOT NULL)
SELECT sample_id, nullif(regexp_extract(content, '(?s)<img>(.*?)</img>', 1), '') path, trim(CASE WHEN regexp_extract(content, '(?s)<img>(.*?)</img>', 1) <> '' THEN split_part(content, '</img>', 2) ELSE replace(content, '<image>', '') END, chr(10)) "text" FROM f WHERE k = 1""")
def picture_of_first_message(spark, d):
    """The picture and the text of the first user message."""
    first = F.try_element_at(F.filter("messages", lambda m: (m["role"] == "user") & m["content"].isNotNull()), F.lit(1))["content"]
    return samples(spark, d).select("sample_id", first.alias("c")).where("c IS NOT NULL").select("sample_id", C.picture_and_text(F.col("c")).alias("x")).select("sample_id", "x.path", "x.text")


@query(f"WITH {V_SQL} SELECT site, CAST(sum(floor(len(messages) / 2)) AS BIGINT) qa_pairs, count(*) n FROM g GROUP BY site")
def qa_pair_count(spark, d):
    """Question and answer pairs by site."""
    s = table(spark, d, "train_samples").select("sample_id", "site", F.size("conversations").alias("messages")).distinct()
    return s.groupBy("site").agg(F.sum(F.floor(F.when(F.col("messages") >= 0, F.col("messages")) / 2)).alias("qa_pairs"), F.count("*").alias("n"))


@query(f"""WITH {V_SQL} SELECT sample_id, turn, CASE WHEN ((NOT starts_with(following, '(') AND NOT ends_with(following, ')')) OR length(following) >= 8) AND instr(content, '(') > 0
THEN substr(content, 1, instr(content, '(') - 1) || '<ref>' || substr(content, instr(content, '(')) ELSE content END tagged FROM t WHERE role = 'user'""")
def ref_tags(spark, d):
    """User messages with a ref tag where the answer is no point."""
    pair = F.transform("messages", lambda m, i: F.struct(i.alias("turn"), m["role"].alias("role"), m["content"].alias("c"), F.try_element_at("messages", i + 2)["content"].alias("a")))
    m = samples(spark, d).select("sample_id", F.explode(pair).alias("x")).where("x.role = 'user'")
    return m.select("sample_id", F.col("x.turn").cast("bigint").alias("turn"), C.ref_tagged(F.col("x.c"), F.col("x.a")).alias("tagged"))


@query(f"""WITH {V_SQL}, r AS (SELECT sample_id, turn, regexp_extract_all(replace(content, 'Tap ', '<ref>'), '<ref>\\s*\\((\\d+),(\\d+)\\)', 1) xs FROM t WHERE content IS NOT NULL) SELECT sample_id, turn, greatest(len(xs), 1) n_points, CASE WHEN len(xs) > 0 THEN CAST(xs[1] AS INT) ELSE -100 END x FROM r""")
def ref_points(spark, d):
    """Points after a ref tag; (-100, -100) where there is none."""
    m = samples(spark, d).select("sample_id", F.posexplode("messages").alias("turn", "m")).where("m.content IS NOT NULL")
    points = P.ref_points(F.replace(F.col("m.content"), F.lit("Tap "), F.lit("<ref>")))
    return m.select("sample_id", F.col("turn").cast("bigint").alias("turn"), F.size(points).cast("bigint").alias("n_points"), points[0][0].alias("x"))


@query(f"""WITH {V_SQL} SELECT sample_id, sha256(array_to_string(list_transform(messages, lambda m: '<|im_start|>' || m.role || chr(10) || coalesce(m.content, '') || '<|im_end|>'), chr(10))) chatml FROM g WHERE cv IS NOT NULL""")
def chatml_hash(spark, d):
    """The hash of each conversation as one marked text."""
    return samples(spark, d).where("conversations IS NOT NULL").select("sample_id", F.sha2(C.chatml(F.col("messages")), 256).alias("chatml"))


@query(f"""WITH {V_SQL}, w AS (SELECT sample_id, turn, role, unnest(list_transform(string_split(coalesce(content, ''), ' '), lambda x: length(x))) l FROM t), c AS (SELECT sample_id, list(CASE WHEN role = 'assistant' THEN l ELSE -100 END ORDER BY turn) a FROM (SELECT sample_id, turn, role, l FROM w) GROUP BY sample_id),
n AS (SELECT sample_id, count(*) n FROM w GROUP BY sample_id) SELECT sample_id, least(n, 64) used, 64 - least(n, 64) padding, CAST(len(list_filter(a[1:64], lambda x: x <> -100)) AS BIGINT) shown FROM c JOIN n USING (sample_id)""")
def label_mask(spark, d):
    """Of 64 positions: used, padded, and shown to the loss."""
    ids, labels = C.masked(F.col("messages"), 64)
    s = samples(spark, d).where("size(messages) > 0").select("sample_id", ids.alias("ids"), labels.alias("labels"), F.aggregate("messages", F.lit(0), lambda n, m: n + F.size(F.split(F.coalesce(m["content"], F.lit("")), " "))).alias("n"))
    used = F.least("n", F.lit(64)).cast("bigint")
    return s.select("sample_id", used.alias("used"), (F.size("ids") - used).alias("padding"), F.size(F.filter("labels", lambda x: x != -100)).cast("bigint").alias("shown"))


@query("""WITH a AS (SELECT DISTINCT 'func' origin, rec_id "key", site FROM func_records UNION ALL SELECT DISTINCT 'talk', sample_id, site FROM train_samples) SELECT origin, site, count(*) n, CAST(sum(key) AS BIGINT) key_sum FROM a GROUP BY ALL""")
def union_sources(spark, d):
    """Two data sets as one, counted by origin and site."""
    a = table(spark, d, "func_records").select(F.lit("func").alias("origin"), F.col("rec_id").alias("key"), "site").distinct()
    b = table(spark, d, "train_samples").select(F.lit("talk").alias("origin"), F.col("sample_id").alias("key"), "site").distinct()
    return C.union(a, b).groupBy("origin", "site").agg(F.count("*").alias("n"), F.sum("key").alias("key_sum"))


@query("""SELECT rec_id, epoch_us(min(ingested_at)) ingested_at, any_value(source) source, any_value(split) split FROM func_records GROUP BY rec_id""")
def first_deliveries(spark, d):
    """The first delivery of each record."""
    r = table(spark, d, "func_records").select("rec_id", "ingested_at", "source", "split")
    return C.kept_first(r, "rec_id", "ingested_at").withColumn("ingested_at", F.unix_micros("ingested_at"))


@query("""WITH r AS (SELECT DISTINCT rec_id, split, device FROM func_records), t AS (SELECT 'func_pred_rec_test' task, 'grounding' grp, rec_id FROM r WHERE split = 'test' UNION ALL SELECT 'websrc_val', 'questions', rec_id FROM r WHERE split = 'val' UNION ALL SELECT 'other', NULL, rec_id FROM r WHERE split = 'train')
SELECT grp, task, count(*) n, CAST(sum(rec_id) AS BIGINT) key_sum FROM t GROUP BY ALL""")
def documents_by_task(spark, d):
    """The documents of several tasks as one table, counted by group and task."""
    catalogue.declare()
    r = table(spark, d, "func_records").select("rec_id", "split").distinct()
    docs = tasks.documents_of({"func_pred_rec_test": r.where("split = 'test'"), "websrc_val": r.where("split = 'val'"), "other": r.where("split = 'train'")})
    return docs.groupBy(F.col("group").alias("grp"), "task").agg(F.count("*").alias("n"), F.sum("rec_id").alias("key_sum"))


@query("""SELECT sample_id, any_value(site) site FROM train_samples GROUP BY sample_id ORDER BY substr(md5('0:' || sample_id), 1, 15), sample_id LIMIT 128""")
def hash_shuffled_sample(spark, d):
    """128 samples in a hashed order."""
    return C.sample(table(spark, d, "train_samples").select("sample_id", "site").distinct(), "sample_id", 128)


H = "CAST('0x' || substr(md5('{}:' || rec_id), 1, 15) AS BIGINT)"
P_SQL = """r AS (SELECT DISTINCT rec_id, func, elem_tag, site FROM func_records WHERE func IS NOT NULL)"""


@query(f"WITH {P_SQL} SELECT rec_id, 'Tag ' || elem_tag || ' on ' || site || ': ' || func prompt FROM r")
def prompt_template(spark, d):
    """A text with the values of columns in its places."""
    r = table(spark, d, "func_records").select("rec_id", "func", "elem_tag", "site").distinct().where("func IS NOT NULL")
    return r.select("rec_id", R.resolved("Tag {{elem_tag}} on {{site}}: {{func}}", r.columns).alias("prompt"))


@query("""WITH e AS (SELECT DISTINCT response_id, model, length(prompt) l FROM eval_responses WHERE prompt IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY l DESC, response_id) k, ntile(7) OVER (PARTITION BY model ORDER BY response_id) part FROM e)
SELECT response_id, (k - 1) // 16 batch, part FROM o""")
def length_batches(spark, d):
    """Requests in batches of 16 by falling length, and in seven near-equal parts."""
    e = table(spark, d, "eval_responses").select("response_id", "model", F.length("prompt").alias("l")).distinct().where("l IS NOT NULL")
    b = R.near_equal(R.batches(e, "model", F.col("l"), 16, "response_id"), "model", 7, "response_id")
    return b.select("response_id", "batch", F.col("part").cast("bigint").alias("part"))


@query("""WITH e AS (SELECT DISTINCT response_id, response_id % 3 + 1 k FROM eval_responses) SELECT response_id, unnest(range(0, k)) repeat FROM e""")
def repeated_requests(spark, d):
    """Each request as often as it is to be repeated."""
    e = table(spark, d, "eval_responses").select("response_id").distinct()
    return R.repeated(e, (F.col("response_id") % 3 + 1).cast("int")).select("response_id", F.col("repeat").cast("bigint").alias("repeat"))


@query(f"""WITH r AS (SELECT DISTINCT rec_id, source, split, func || ' ' || coalesce(elem_tag, '') t FROM func_records WHERE func IS NOT NULL AND source IS NOT NULL),
p AS (SELECT source, rec_id, t, row_number() OVER (PARTITION BY source ORDER BY {H.format(1234)}, rec_id) - 1 i FROM r WHERE split = 'train'), z AS (SELECT source, count(*) n FROM p GROUP BY source),
d AS (SELECT r.*, n, {H.format(1235)} % n s FROM r LEFT JOIN z USING (source) WHERE split = 'test'), e AS (SELECT rec_id doc, source, n, s, unnest(range(0, least(3, n))) j FROM d WHERE n > 0),
y AS (SELECT doc rec_id, list(p.t ORDER BY j)[1:2] shots FROM e JOIN p ON p.source = e.source AND p.i = (e.s + e.j) % e.n WHERE p.rec_id <> e.doc GROUP BY doc)
SELECT rec_id, array_to_string(list_concat(coalesce(shots, []), [t]), chr(10) || chr(10)) context FROM d LEFT JOIN y USING (rec_id)""")
def few_shot_context(spark, d):
    """Prompts with two examples of the same source in front."""
    r = table(spark, d, "func_records").select("rec_id", "source", "func", "elem_tag", "split").distinct().where("func IS NOT NULL AND source IS NOT NULL")
    text = F.concat_ws(" ", "func", F.coalesce("elem_tag", F.lit("")))
    return R.few_shot(r.where("split = 'test'"), r.where("split = 'train'"), 2, "source", "rec_id", text).select("rec_id", "context")
