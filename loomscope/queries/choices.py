"""Multiple choice and likelihoods: the first four numbers of an embedding are the choices' log likelihoods, its label the gold choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomscope.operators import aggregates as A
from loomscope.operators import requests as R
from loomscope.operators import scoring as S
from loomscope.queries.registry import query
from loomscope.session import table

LENGTHS = (4, 7, 5, 9)


def docs(spark, d):
    """Documents with conditional and unconditional log likelihoods of four choices."""
    e = table(spark, d, "embeddings")
    ll = lambda lo: F.transform(F.slice("embedding", lo, 4), lambda x: x.cast("double") * 10)
    return e.select("vec_id", "label", (F.col("label") % 4).alias("gold"), ll(1).alias("lls"), ll(5).alias("free"), F.array(*(F.lit(n) for n in LENGTHS)).alias("lens"))


C_SQL = """
c0 AS (SELECT vec_id, label, label % 4 gold, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE) * 10) lls, list_transform(embedding[5:8], lambda x: CAST(x AS DOUBLE) * 10) free FROM embeddings),
c1 AS (SELECT *, [lls[1] / 4, lls[2] / 7, lls[3] / 5, lls[4] / 9] norm, [lls[1] - free[1], lls[2] - free[2], lls[3] - free[3], lls[4] - free[4]] mi FROM c0),
c AS (SELECT *, list_position(lls, list_max(lls)) - 1 p, list_position(norm, list_max(norm)) - 1 pn, list_position(mi, list_max(mi)) - 1 pm FROM c1)"""


@query(f"WITH {C_SQL} SELECT label % 2 task, round(avg(CASE WHEN p = gold THEN 1.0 ELSE 0.0 END), 6) acc, round(avg(CASE WHEN pn = gold THEN 1.0 ELSE 0.0 END), 6) acc_norm, round(avg(CASE WHEN pm = gold THEN 1.0 ELSE 0.0 END), 6) acc_mutual_info FROM c GROUP BY 1")
def mc_accuracy(spark, d):
    """Accuracy of the likeliest choice: as it is, by length, and against its unconditional likelihood."""
    c = docs(spark, d)
    hits = {k: (S.argmax(v) == F.col("gold")).cast("double") for k, v in (("acc", F.col("lls")), ("acc_norm", S.by_length(F.col("lls"), F.col("lens"))), ("acc_mutual_info", S.mutual_information(F.col("lls"), F.col("free"))))}
    return c.groupBy((F.col("label") % 2).alias("task")).agg(*(F.round(F.avg(v), 6).alias(k) for k, v in hits.items()))


@query(f"WITH {C_SQL} SELECT vec_id, unnest([0, 1, 2, 3]) idx, unnest(lls) ll FROM c".replace("unnest(lls) ll", "round(unnest(lls), 6) ll"))
def choice_requests(spark, d):
    """A likelihood request for each choice."""
    return S.choice_requests(docs(spark, d), ["vec_id"], "lls").select("vec_id", "idx", F.round("value", 6).alias("ll"))


@query(f"WITH {C_SQL} SELECT label, round(avg(exp(lls[1])), 6) perplexity, round(exp(-(sum(lls[1]) / sum(4 + label))), 6) weighted_perplexity, round(-(sum(lls[1]) / sum(4 + label)) / ln(2), 6) bits_per_byte, round(avg(CASE WHEN lls[1] > 0 THEN 1.0 ELSE 0.0 END), 6) greedy FROM c GROUP BY label")
def loglikelihood_metrics(spark, d):
    """Perplexities and bits per byte of the first choice."""
    ll, size = F.col("lls")[0], F.lit(4) + F.col("label")
    return docs(spark, d).groupBy("label").agg(
        F.round(A.perplexity(ll), 6).alias("perplexity"), F.round(A.weighted_perplexity(ll, size), 6).alias("weighted_perplexity"),
        F.round(A.bits_per_byte(ll, size), 6).alias("bits_per_byte"), F.round(F.avg((ll > 0).cast("double")), 6).alias("greedy"),
    )


@query(f"""WITH {C_SQL}, b AS (SELECT label, CASE WHEN gold = 1 THEN 1 ELSE 0 END g, CASE WHEN p = 1 THEN 1 ELSE 0 END q FROM c),
n AS (SELECT label % 5 task, CAST(count(*) FILTER (WHERE g = 1 AND q = 1) AS DOUBLE) tp, CAST(count(*) FILTER (WHERE g = 0 AND q = 1) AS DOUBLE) fp, CAST(count(*) FILTER (WHERE g = 1 AND q = 0) AS DOUBLE) fn, CAST(count(*) FILTER (WHERE g = 0 AND q = 0) AS DOUBLE) tn FROM b GROUP BY 1)
SELECT task, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) f1, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) mcc FROM n""")
def binary_f1_mcc(spark, d):
    """F1 and Matthews correlation of whether the second choice is gold."""
    b = docs(spark, d).select((F.col("label") % 5).alias("task"), (F.col("gold") == 1).cast("int").alias("g"), (S.argmax(F.col("lls")) == 1).cast("int").alias("q"))
    one = b.groupBy("task").agg(F.round(A.f1(F.col("g"), F.col("q")), 6).alias("f1"))
    return one.join(A.matthews(b, ["task"], "g", "q").withColumn("mcc", F.round("mcc", 6)), "task")


@query(f"""WITH {C_SQL}, k AS (SELECT gold, p, CAST(count(*) AS DOUBLE) n FROM c GROUP BY ALL), s AS (SELECT sum(n) s, sum(CASE WHEN gold = p THEN n ELSE 0 END) c FROM k),
t AS (SELECT gold k, sum(n) t FROM k GROUP BY 1), q AS (SELECT p k, sum(n) p FROM k GROUP BY 1), x AS (SELECT sum(coalesce(t, 0) * coalesce(p, 0)) tp, sum(power(coalesce(t, 0), 2)) tt, sum(power(coalesce(p, 0), 2)) pp FROM t FULL JOIN q USING (k))
SELECT round((c * s - tp) / sqrt((s * s - pp) * (s * s - tt)), 6) mcc FROM s, x""")
def multiclass_mcc(spark, d):
    """Matthews correlation over all four choices."""
    b = docs(spark, d).select(F.lit(1).alias("one"), "gold", S.argmax(F.col("lls")).alias("p"))
    return A.matthews(b, ["one"], "gold", "p").select(F.round("mcc", 6).alias("mcc"))


@query(f"WITH {C_SQL}, g AS (SELECT vec_id // 3 paragraph, label, bool_and((p = gold) OR label > 6) ok FROM c GROUP BY ALL) SELECT round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) acc_all FROM g")
def all_answers_correct(spark, d):
    """Questions of which every answer is right."""
    c = docs(spark, d).withColumns({"paragraph": F.floor(F.col("vec_id") / 3), "ok": (S.argmax(F.col("lls")) == F.col("gold")) | (F.col("label") > 6)})
    return A.all_correct(c, ["paragraph", "label"], F.lit(True), F.col("ok")).select(F.round("acc_all", 6).alias("acc_all"))


@query(f"WITH {C_SQL} SELECT label % 2 task, round(avg(CASE WHEN p = gold OR p = label THEN 1.0 ELSE 0.0 END), 6) acc, count(*) n FROM c GROUP BY 1")
def mc_accuracy_any(spark, d):
    """Accuracy where each document has several gold choices, some of which are none of its choices."""
    c = docs(spark, d)
    golds = S.gold_indices(F.array(F.col("gold"), F.col("label"), F.lit(-1)), F.size("lls"))
    return c.groupBy((F.col("label") % 2).alias("task")).agg(F.round(F.avg(S.in_gold(S.argmax(F.col("lls")), golds)), 6).alias("acc"), F.count("*").alias("n"))


@query(f"""WITH {C_SQL}, q AS (SELECT vec_id, unnest([0, 1, 2, 3]) idx, unnest(lls) ll FROM c), r AS (SELECT vec_id, idx, ll, unnest([0, 1]) repeat FROM q)
SELECT vec_id doc_id, idx, repeat, CASE WHEN (vec_id + idx + repeat) % 3 <> 0 THEN round(ll, 6) END response FROM r""")
def answered_requests(spark, d):
    """Requests of two repeats joined with their responses, of which a third is missing and some come twice."""
    asked = S.choice_requests(docs(spark, d), ["vec_id"], "lls").select(F.lit("mc").alias("task"), F.col("vec_id").alias("doc_id"), "idx", "value")
    asked = R.repeated(asked, F.lit(2))
    there = asked.where((F.col("doc_id") + F.col("idx") + F.col("repeat")) % 3 != 0).select(*R.REQUEST, F.round("value", 6).alias("response"))
    out = R.answered(asked.drop("value"), there.unionByName(there.where("idx = 0")))
    return out.select("doc_id", "idx", "repeat", "response")
