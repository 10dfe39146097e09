"""Sources mixed to target shares of the tokens by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscope.llm.tokens import TOKENIZER, token_count
from loomscope.session import spread, table, written

#: Rows of the plan table that the driver handles; the table is small by nature and this is checked.
MOST_TARGETS = 10_000
#: The part of the largest reachable total that is aimed at: rates stay below the repeat cap.
FILL = 0.98
#: Newton iterations, and the relative error of a source's tokens that ends them.
ITERATIONS, TOLERANCE = 40, 1e-4
#: Shifts of the random numbers that are tried when rates are rounded to copies.
SHIFTS = 32

TARGETS = "plan_name STRING, source STRING, target_share DOUBLE, max_repeats INT, wanted DOUBLE, mean DOUBLE, tilt DOUBLE"


def _rate(tilt: Column, tokens: Column, cap: Column, mean: Column) -> Column:
    """Copies of a document: one at tilt 0 (half a copy if the cap is one), tilted exponentially by its tokens, below the cap."""
    base = F.when(cap > 1, 1 / cap).otherwise(0.5)
    power = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), tilt * tokens / mean))
    return cap * base * F.exp(power) / (1 - base + base * F.exp(power))


def mix_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """:data:`TARGETS`: for each plan and source the tokens wanted and the tilt that gives them.

    sizes: ``source, n_tokens, n`` (documents of that size). The rates solve the dual of entropy balancing: among all
    rates below the caps they are closest to the base rates while each source has its tokens. The dual is convex
    and has one variable for each source of a plan; each Newton iteration sums gradient and curvature over all
    sizes in the cluster, and steps that leave the known bracket are halved into it.
    """
    spark = sizes.sparkSession
    plan = targets.groupBy("plan_name", "source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    plan = [r.asDict() for r in plan.limit(MOST_TARGETS + 1).collect()]
    if len(plan) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} plan rows")
    names = spark.createDataFrame([(r["source"],) for r in plan], "source STRING").distinct()
    there = sizes.join(F.broadcast(names), "source").groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"))
    there = {r["source"]: r for r in there.collect()}
    for r in plan:
        s = there.get(r["source"])
        r |= {"tokens": s["tokens"] if s else 0, "mean": s["tokens"] / s["docs"] if s and s["tokens"] else 1.0, "tilt": 0.0, "low": -math.inf, "high": math.inf}
    for r in plan:
        can = [x["cap"] * x["tokens"] / x["share"] for x in plan if x["plan_name"] == r["plan_name"] and x["share"] > 0 and x["cap"] > 0 and x["tokens"]]
        r["wanted"] = FILL * min(can) * r["share"] if can and r["tokens"] and r["cap"] > 0 else 0.0
    left = [r for r in plan if r["wanted"] > 0]
    for _ in range(ITERATIONS):
        if not left:
            break
        step = spark.createDataFrame([(i, r["source"], float(r["cap"]), r["mean"], r["tilt"]) for i, r in enumerate(left)], "i INT, source STRING, cap DOUBLE, mean DOUBLE, tilt DOUBLE")
        rate = _rate(F.col("tilt"), F.col("n_tokens"), F.col("cap"), F.col("mean"))
        rows = sizes.join(F.broadcast(step), "source").withColumn("rate", rate)
        slope = F.col("rate") * (1 - F.col("rate") / F.col("cap")) * F.col("n_tokens") ** 2 / F.col("mean")
        sums = rows.groupBy("i").agg(F.sum(F.col("n") * F.col("rate") * F.col("n_tokens")).alias("has"), F.sum(F.col("n") * slope).alias("slope")).collect()
        for s in sums:
            r = left[s["i"]]
            off = s["has"] - r["wanted"]
            r["done"] = abs(off) <= TOLERANCE * r["wanted"]
            r["low" if off < 0 else "high"] = r["tilt"]
            nxt = r["tilt"] - off / s["slope"] if s["slope"] else math.inf
            if not r["low"] < nxt < r["high"] or abs(nxt - r["tilt"]) > 4:
                ends = (r["low"], r["high"])
                nxt = sum(ends) / 2 if all(map(math.isfinite, ends)) else r["tilt"] + math.copysign(1.0 + abs(r["tilt"]), -off)
            r["tilt"] = r["tilt"] if r["done"] else nxt
        left = [r for r in left if not r["done"]]
    if left:
        raise ValueError(f"no rates found in {ITERATIONS} iterations: {[(r['plan_name'], r['source']) for r in left]}")
    return spark.createDataFrame([(r["plan_name"], r["source"], r["share"], r["cap"], r["wanted"], float(r["mean"]), r["tilt"]) for r in plan], TARGETS)


def mixed(docs: DataFrame, targets: DataFrame, seed: int = 5, tokenizer: str = TOKENIZER) -> DataFrame:
    """The chosen documents: ``plan_name, source, doc_id, n_tokens, copies`` (1 or more, at most ``max_repeats``).

    docs: ``doc_id BIGINT, source STRING, text STRING``; targets: ``plan_name, source, target_share, max_repeats``.
    The total of a plan is what its scarcest source allows. Each rate is rounded to copies with a hash of the
    document; of a few shifts of these random numbers each source takes the one whose tokens come closest.

    Null and empty texts (no tokens) and null sources are never chosen; a source without documents or with
    ``max_repeats`` of 0 gets nothing and the others keep their proportions. A repeated plan row counts once with
    the sum of the shares and the least cap. A repeated ``doc_id`` is one document for each row. Other columns are ignored.
    """
    sized = spread(docs.select("doc_id", "source", "text")).where("text IS NOT NULL AND source IS NOT NULL").select("doc_id", "source", token_count("text", tokenizer).alias("n_tokens"))
    sized = written(sized.where("n_tokens > 0"), "sizes")
    plan = mix_rates(written(sized.groupBy("source", "n_tokens").agg(F.count("*").alias("n")), "histogram"), targets)
    plan = written(plan.where("wanted > 0"), "plan")
    rows = sized.join(F.broadcast(plan), "source").withColumn("rate", _rate(F.col("tilt"), F.col("n_tokens"), F.col("max_repeats"), F.col("mean")))
    random = F.pmod(F.xxhash64("doc_id", "plan_name", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn("random", random)

    def copies(shift: Column) -> Column:
        u = F.col("random") + shift
        return F.floor(F.col("rate") + u - F.floor(u)).cast("int")

    tried = rows.groupBy("plan_name", "source").agg(*(F.sum(copies(F.lit(k / SHIFTS)) * F.col("n_tokens")).alias(f"s{k}") for k in range(SHIFTS)))
    tried = tried.join(F.broadcast(plan.select("plan_name", "source", "wanted")), ["plan_name", "source"])
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"s{k}") - F.col("wanted")).alias("off"), F.lit(k / SHIFTS).alias("shift")) for k in range(SHIFTS))))
    tried = written(tried.select("plan_name", "source", best["shift"].alias("shift")), "shifts")
    rows = rows.join(F.broadcast(tried), ["plan_name", "source"]).withColumn("copies", copies(F.col("shift")))
    return rows.where("copies > 0").select("plan_name", "source", "doc_id", "n_tokens", "copies")


def mix_shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of the tokens of each source of each plan, with its documents and copies."""
    plan = targets.groupBy("plan_name", "source").agg(F.sum("target_share").alias("target_share"))
    sums = chosen.groupBy("plan_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"))
    total = sums.groupBy("plan_name").agg(F.sum("tokens").alias("total"))
    out = plan.join(F.broadcast(sums), ["plan_name", "source"], "left").join(F.broadcast(total), "plan_name", "left")  # a row a plan row
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("tokens", "documents", "copies")}
    return out.withColumns(zero).withColumn("actual_share", F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6)).drop("total")


def p6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents of ``documents`` and their copies for every plan of ``mix_targets``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs, table(spark, sf_dir, "mix_targets"))


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares."""
    return mix_shares(p6_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
