"""Text metrics. Each record's text is scored against that of the record with the next id."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomscope.functions import text as X
from loomscope.functions.parse import until_stop
from loomscope.operators import aggregates as A
from loomscope.operators import captions as C
from loomscope.queries.registry import query
from loomscope.session import table


def pairs(spark, d, column):
    """Pairs of texts, letters, digits and blanks only."""
    r = table(spark, d, "func_records").select("rec_id", "source", column).distinct().where(f"{column} IS NOT NULL")
    clean = F.trim(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", " "))
    r = r.select("rec_id", "source", clean.alias("gold"))
    after = r.select((F.col("rec_id") - 1).alias("rec_id"), F.col("gold").alias("pred"))
    return r.join(after, "rec_id")


def _p(column: str) -> str:
    return f"""p0 AS (SELECT DISTINCT rec_id, source, trim(regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) gold FROM func_records WHERE {column} IS NOT NULL),
p AS (SELECT a.rec_id, a.source, a.gold, b.gold pred FROM p0 a JOIN p0 b ON b.rec_id = a.rec_id + 1)"""


CHARS = "list_distinct(regexp_extract_all(regexp_replace({}, '[^a-z0-9]', '', 'g'), '.'))"
WORDS = "list_distinct(regexp_extract_all({}, '[a-z0-9]+'))"


@query(f"""WITH {_p("elem_text")}, x AS (SELECT *, CASE WHEN greatest(length(gold), length(pred)) = 0 THEN 1.0 ELSE 1 - levenshtein(gold, pred) / greatest(length(gold), length(pred)) END s FROM p)
SELECT source, round(avg(CASE WHEN s >= 0.5 THEN s ELSE 0.0 END), 6) anls, count(*) n FROM x GROUP BY source""")
def anls(spark, d):
    """Mean normalised Levenshtein similarity of captions by source."""
    return pairs(spark, d, "elem_text").groupBy("source").agg(F.round(F.avg(X.anls(F.array("gold"), F.col("pred"))), 6).alias("anls"), F.count("*").alias("n"))


@query(f"""WITH {_p("elem_text")}, x AS (SELECT source, {CHARS.format("gold")} a, {CHARS.format("pred")} b, {WORDS.format("gold")} c, {WORDS.format("pred")} e FROM p),
y AS (SELECT source, coalesce(2.0 * len(list_intersect(a, b)) / nullif(len(a) + len(b), 0), 0) f, coalesce(2.0 * len(list_intersect(c, e)) / nullif(len(c) + len(e), 0), 0) t FROM x)
SELECT source, round(avg(f), 6) char_set_f1, round(avg(t), 6) token_f1 FROM y GROUP BY source""")
def answer_f1(spark, d):
    """F1 over sets of characters and over sets of words, by source."""
    p = pairs(spark, d, "elem_text")
    return p.groupBy("source").agg(F.round(F.avg(X.char_set_f1(F.col("gold"), F.col("pred"))), 6).alias("char_set_f1"), F.round(F.avg(X.token_f1(F.col("gold"), F.col("pred"))), 6).alias("token_f1"))


@query(f"""WITH {_p("elem_text")}, x AS (SELECT source, {CHARS.format("gold")} a, {CHARS.format("pred")} b FROM p), y AS (SELECT source, avg(coalesce(2.0 * len(list_intersect(a, b)) / nullif(len(a) + len(b), 0), 0)) f, count(*) n FROM x GROUP BY source)
SELECT round(sum(f * n) / sum(n), 6) f1, sum(n) n FROM y""".replace("sum(n) n", "CAST(sum(n) AS BIGINT) n"))
def domain_weighted_f1(spark, d):
    """Character F1 by source, weighted by the sources' sizes."""
    p = pairs(spark, d, "elem_text").groupBy("source").agg(F.avg(X.char_set_f1(F.col("gold"), F.col("pred"))).alias("f"), F.count("*").alias("n"))
    return p.agg(F.round(A.weighted_mean(F.col("f") * F.col("n"), F.col("n")), 6).alias("f1"), F.sum("n").alias("n"))


@query(r"""WITH r AS (SELECT DISTINCT rec_id, source, elem_text, elem_role FROM func_records WHERE elem_text IS NOT NULL AND elem_role IS NOT NULL)
SELECT source, count(*) n, CAST(count(*) FILTER (WHERE elem_text = elem_role) AS BIGINT) exact, CAST(count(*) FILTER (WHERE lower(regexp_replace(elem_text, '[0-9!-/:-@\[-`{-~]', '', 'g')) = lower(regexp_replace(elem_role, '[0-9!-/:-@\[-`{-~]', '', 'g'))) AS BIGINT) loose,
CAST(count(*) FILTER (WHERE regexp_replace(elem_text, 'e', '', 'g') = regexp_replace(elem_role, 'e', '', 'g')) AS BIGINT) ignoring FROM r GROUP BY source""")
def exact_match(spark, d):
    """Captions that equal the role: exactly, without case, punctuation and digits, and without a pattern."""
    r = table(spark, d, "func_records").select("rec_id", "source", "elem_text", "elem_role").distinct().where("elem_text IS NOT NULL AND elem_role IS NOT NULL")
    a, b = F.col("elem_text"), F.col("elem_role")
    return r.groupBy("source").agg(F.count("*").alias("n"), F.count_if(X.matches(a, b)).alias("exact"), F.count_if(X.matches(a, b, case=True, punctuation=True, numbers=True)).alias("loose"), F.count_if(X.matches(a, b, ignore=["e"])).alias("ignoring"))


GRAMS = """g AS (SELECT rec_id, source, side, n, array_to_string(w[i:i + n - 1], ' ') g FROM (SELECT rec_id, source, side, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) i FROM w, (SELECT unnest([1, 2, 3, 4]) n)))"""


@query(f"""WITH {_p("func")}, w AS (SELECT rec_id, source, 'r' side, list_filter(string_split(gold, ' '), lambda x: x <> '') w FROM p UNION ALL SELECT rec_id, source, 'p', list_filter(string_split(pred, ' '), lambda x: x <> '') FROM p), {GRAMS},
c AS (SELECT rec_id, source, n, g, count(*) FILTER (WHERE side = 'r') r, count(*) FILTER (WHERE side = 'p') p FROM g GROUP BY ALL),
o AS (SELECT source, n, CAST(sum(least(r, p)) AS DOUBLE) hit, CAST(sum(p) AS DOUBLE) total FROM c GROUP BY ALL),
l AS (SELECT source, CAST(sum(len(w)) FILTER (WHERE side = 'r') AS DOUBLE) rl, CAST(sum(len(w)) FILTER (WHERE side = 'p') AS DOUBLE) sl FROM w GROUP BY source),
z AS (SELECT *, CASE WHEN hit = 0 THEN count(*) FILTER (WHERE hit = 0) OVER (PARTITION BY source ORDER BY n) ELSE 0 END k FROM o)
SELECT source, round(100 * CASE WHEN any_value(sl) >= any_value(rl) THEN 1.0 ELSE exp(1 - any_value(rl) / any_value(sl)) END * exp(sum(ln(CASE WHEN hit = 0 THEN power(0.5, k) ELSE hit END / total)) / 4), 6) bleu FROM z JOIN l USING (source) GROUP BY source""")
def bleu(spark, d):
    """Corpus BLEU of function texts by source."""
    p = pairs(spark, d, "func")
    out = A.corpus_bleu(p, ["source"], F.col("gold"), F.col("pred"))
    return out.select("source", F.round("bleu", 6).alias("bleu"))


@query(f"""WITH {_p("elem_text")}, w AS (SELECT rec_id, source, side, regexp_extract_all(replace(t, ' ', ''), '.') w FROM (SELECT rec_id, source, 'r' side, gold t FROM p UNION ALL SELECT rec_id, source, 'p', pred FROM p)),
{GRAMS.replace("[1, 2, 3, 4]", "[1, 2, 3, 4, 5, 6]")}, c AS (SELECT rec_id, source, n, g, count(*) FILTER (WHERE side = 'r') r, count(*) FILTER (WHERE side = 'p') p FROM g GROUP BY ALL),
o AS (SELECT source, n, CAST(sum(least(r, p)) AS DOUBLE) h, CAST(sum(r) AS DOUBLE) r, CAST(sum(p) AS DOUBLE) p FROM c GROUP BY ALL),
m AS (SELECT source, avg(h / p) pr, avg(h / r) re FROM o WHERE r > 0 AND p > 0 GROUP BY source)
SELECT source, round(100 * coalesce(5 * pr * re / nullif(4 * pr + re, 0), 0), 6) chrf FROM m""")
def chrf(spark, d):
    """Corpus chrF of captions by source."""
    p = pairs(spark, d, "elem_text")
    return C.corpus_chrf(p, ["source"], F.col("gold"), F.col("pred")).select("source", F.round("chrf", 6).alias("chrf"))


@query(f"""WITH {_p("elem_text")}, w AS (SELECT rec_id, source, 'r' side, string_split(gold, ' ') w FROM p UNION ALL SELECT rec_id, source, 'p', string_split(pred, ' ') FROM p), {GRAMS},
c AS (SELECT rec_id, n, g, count(*) FILTER (WHERE side = 'r') r, count(*) FILTER (WHERE side = 'p') p FROM g GROUP BY ALL), f AS (SELECT n, g, count(*) df FROM c WHERE r > 0 GROUP BY ALL),
v AS (SELECT c.*, (SELECT ln(count(*)) FROM p) - ln(greatest(coalesce(df, 1), 1)) idf FROM c LEFT JOIN f USING (n, g)),
s AS (SELECT rec_id, n, sum(least(r * idf, p * idf) * r * idf) / nullif(sqrt(sum(power(r * idf, 2))) * sqrt(sum(power(p * idf, 2))), 0) sim FROM v GROUP BY ALL),
t AS (SELECT rec_id, sum(coalesce(sim, 0)) sim FROM s GROUP BY rec_id)
SELECT source, round(avg(10 * coalesce(sim, 0) / 4 * exp(-power(len(string_split(gold, ' ')) - len(string_split(pred, ' ')), 2) / 72.0)), 5) cider FROM p LEFT JOIN t USING (rec_id) GROUP BY source""")
def cider(spark, d):
    """Mean CIDEr of captions by source."""
    p = pairs(spark, d, "elem_text")
    one = C.cider(p, "rec_id", F.split("gold", " "), F.split("pred", " "))
    return p.select("rec_id", "source").join(one, "rec_id").groupBy("source").agg(F.round(F.avg("cider"), 5).alias("cider"))


@query(f"""WITH {_p("func")}, w AS (SELECT rec_id, source, 'r' side, list_filter(string_split(gold, ' '), lambda x: x <> '') w FROM p UNION ALL SELECT rec_id, source, 'p', list_filter(string_split(pred, ' '), lambda x: x <> '') FROM p), {GRAMS},
c AS (SELECT rec_id, source, n, g, count(*) FILTER (WHERE side = 'r') r, count(*) FILTER (WHERE side = 'p') p FROM g GROUP BY ALL), o AS (SELECT source, n, CAST(sum(least(r, p)) AS DOUBLE) hit, CAST(sum(p) AS DOUBLE) total FROM c GROUP BY ALL),
l AS (SELECT source, CAST(sum(len(w)) FILTER (WHERE side = 'r') AS DOUBLE) rl, CAST(sum(len(w)) FILTER (WHERE side = 'p') AS DOUBLE) sl FROM w GROUP BY source),
b AS (SELECT source, n, CASE WHEN sl < rl THEN exp(1 - rl / sl) ELSE 1 END * exp(sum(ln((hit + 1e-15) / (total + 1e-9))) OVER (PARTITION BY source ORDER BY n) / n) v FROM o JOIN l USING (source))
SELECT source, round(max(v) FILTER (WHERE n = 1), 6) bleu_1, round(max(v) FILTER (WHERE n = 2), 6) bleu_2, round(max(v) FILTER (WHERE n = 3), 6) bleu_3, round(max(v) FILTER (WHERE n = 4), 6) bleu_4 FROM b GROUP BY source""")
def caption_bleus(spark, d):
    """BLEU of function texts up to each order, as captions are scored, by source."""
    out = C.caption_bleus(pairs(spark, d, "func"), ["source"], F.col("gold"), F.col("pred"))
    return out.select("source", *(F.round(f"bleu_{n}", 6).alias(f"bleu_{n}") for n in range(1, 5)))


@query()
def rouge_l(spark, d):
    """Mean ROUGE-L of function texts by source (longest common subsequences have no SQL form that ends on whole tables)."""
    scored = pairs(spark, d, "func").withColumn("score", C.rouge_l(F.col("gold"), F.col("pred")))
    return scored.groupBy("source").agg(F.round(F.avg("score"), 6).alias("rouge_l"), F.count("*").alias("n"))


@query()
def ter(spark, d):
    """Translation edit rate of captions by source (its greedy shift search has no SQL form)."""
    p = pairs(spark, d, "elem_text")
    return A.corpus_ter(p, ["source"], F.col("gold"), F.col("pred")).select("source", F.round("ter", 6).alias("ter"))


@query()
def corpus_stderr(spark, d):
    """Standard errors of BLEU and chrF of function texts by source, over resamples (whose draws have no SQL form)."""
    p = pairs(spark, d, "func")
    each = [A.bootstrap_summed_stderr(m, p, ["source"], "rec_id", F.col("gold"), F.col("pred")).withColumn("metric", F.lit(m)) for m in ("bleu", "chrf")]
    return each[0].unionByName(each[1]).select("source", "metric", F.round("stderr", 6).alias("stderr"), "resamples")


@query(r"""SELECT doc_id, strlen(text) bytes, NOT regexp_matches(text, '[^\x00-\x7F]') ascii, split_part(split_part(text, '. ', 1), chr(10), 1) until_stop, md5(text) fingerprint,
md5(regexp_replace(replace(replace(replace(replace(replace(text, ' n''t', 'n''t'), ' )', ')'), '( ', '('), '" ', '"'), ' "', '"'), ' ([''.,])', '\1', 'g')) detokenised FROM documents WHERE text IS NOT NULL""")
def text_scalars(spark, d):
    """Bytes, ASCII flag, text up to a stop sequence, fingerprint, and that of the text without spaces before punctuation."""
    t = F.col("text")
    return table(spark, d, "documents").where("text IS NOT NULL").select(
        "doc_id", F.octet_length(t).cast("bigint").alias("bytes"), X.is_ascii(t).alias("ascii"), until_stop(t, [". ", "\n"]).alias("until_stop"), F.md5(t).alias("fingerprint"), F.md5(X.detokenised(t)).alias("detokenised")
    )
