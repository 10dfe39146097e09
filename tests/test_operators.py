import random
import statistics

import pytest
from pyspark.sql import functions as F

from loomscope.operators import aggregates as A
from loomscope.operators import captions, curate, filters, history, report, requests, scoring
from loomscope.plans import tasks
from loomscope.sources import io
from loomscope.streaming import scores


def apply(spark, responses, steps, extra="", values=()):
    df = spark.createDataFrame([(responses, *values)], "r ARRAY<STRING>" + extra)
    return df.select(filters.pipeline(steps)(F.col("r"))).first()[0]


def test_filters(spark):
    assert apply(spark, ["b", "a", "a", "b"], [("majority_vote", {})]) == ["b"]
    assert apply(spark, [], [("majority_vote", {})]) == []
    assert apply(spark, ["x"], [("take_first", {})]) == "x"
    assert apply(spark, ["  x", "y"], [("remove_whitespace", {}), ("uppercase", {})]) == [" X", "Y"]
    assert apply(spark, ["a 12 b 34", "no"], [("regex", {"pattern": r"\d+", "group_select": -1})]) == ["34", "[invalid]"]
    assert apply(spark, ["k=, v=3"], [("regex", {"pattern": r"k=(\d*)|v=(\d*)", "group_select": 1, "groups": 2})]) == ["3"]
    assert apply(spark, ["a", "z"], [("map", {"mapping": {"a": "1"}, "default": "?"})]) == ["1", "?"]
    got = apply(spark, ["(B)", "it is the red one.", "answer: C", "none"], [("multi_choice_regex", {})], ", choices ARRAY<STRING>", (["Blue", "Red"],))
    assert got == ["(B)", "(B)", "[invalid]", "[invalid]"]  # there is no option C
    got = apply(spark, ["(A) or (B)", "answer: B", "RED!"], [("multi_choice_regex", {"group_select": -1, "ignore_case": False})], ", choices ARRAY<STRING>", (["Blue", "Red"],))
    assert got == ["(B)", "(B)", "[invalid]"]


def test_majority_by_key_breaks_ties_by_order(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "y"), (2, 1, "b"), (2, 2, "a")], "k INT, i INT, response STRING")
    assert {r.k: r.response for r in filters.majority(df, ["k"], "i").collect()} == {1: "y", 2: "b"}


def test_matthews_and_f1(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "g INT, p INT")
    assert df.agg(A.f1(F.col("g"), F.col("p"))).first()[0] == pytest.approx(2 / 3)
    assert A.matthews(df.withColumn("k", F.lit(1)), ["k"], "g", "p").first().mcc == pytest.approx(0.5773502)
    assert A.matthews(df.where("g = 0").withColumn("k", F.lit(1)), ["k"], "g", "p").first().mcc == 0


def test_pooled_of_two_tasks(spark):
    a, b = [0.0, 1.0, 1.0], [1.0, 0.0, 0.0, 1.0]
    rows = [(i, statistics.mean(x), statistics.stdev(x), len(x)) for i, x in enumerate((a, b))]
    df = spark.createDataFrame(rows, "ord INT, m DOUBLE, se DOUBLE, n BIGINT")
    p = df.agg(A.pooled(F.collect_list(F.struct("ord", "m", "se", "n")))).first()[0]
    assert p["mean"] == pytest.approx(statistics.mean(a + b)) and p["n"] == 7
    assert p["stderr"] == pytest.approx(statistics.stdev(a + b))


def test_positional_median_is_not_the_median(spark):
    df = spark.createDataFrame([(0, 9.0), (1, 1.0), (2, 5.0)], "i INT, v DOUBLE").withColumn("k", F.lit(1))
    assert A.middle_in_order(df, ["k"], "i", "v").first().middle == 1.0


def test_bootstrap_is_reproducible(spark):
    draw = random.Random(6)
    held = [round(draw.gauss(2, 1), 1) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in [*held, None]], "v DOUBLE")
    a, b = (A.bootstrap_mean_stderr(d, "v", iterations=1000).first() for d in (df, df.repartition(5)))
    assert a.stderr == pytest.approx(b.stderr) and a.resamples == 1000
    assert a.stderr == pytest.approx(statistics.stdev(held) / len(held) ** 0.5, rel=0.1)
    assert A.bootstrap_mean_stderr(df, "v", F.exp, iterations=200).first().stderr > a.stderr
    assert A.bootstrap_mean_stderr(df.limit(0), "v", iterations=10).first().resamples == 0


def test_bootstrap_of_the_median_has_no_limit(spark):
    draw = random.Random(4)
    held = [round(draw.gauss(0, 1), 2) for _ in range(400)] + [0.5] * 101
    df = spark.createDataFrame([(v,) for v in [*held, None]], "v DOUBLE")
    got = [A.bootstrap_median_stderr(d, "v", 2000).first() for d in (df, df.repartition(5))]
    stats = [sorted(draw.choices(held, k=len(held)))[len(held) // 2] for _ in range(2000)]
    assert got[0].resamples == 2000 and got[0].stderr == pytest.approx(got[1].stderr)
    assert got[0].stderr == pytest.approx(statistics.stdev(stats), rel=0.1)
    assert A.bootstrap_median_stderr(df.limit(0), "v", 10).first().resamples == 0


@pytest.mark.parametrize("steps", [1, 3, 1024])
def test_medians_are_exact(spark, steps):
    draw = random.Random(2)
    rows = [(k, draw.choice([None, 0.5, draw.random(), draw.random()])) for k in ("a", "b", None) for _ in range(draw.randint(30, 61))] + [("one", 3.0), ("none", None)]
    got = {r.k: r["m"] for r in A.medians(spark.createDataFrame(rows, "k STRING, v DOUBLE"), ["k"], "v", "m", steps).collect()}
    want = {k: statistics.median(v for x, v in rows if x == k and v is not None) for k in ("a", "b", None, "one")}
    assert got == pytest.approx(want)


def test_numbering_keeps_every_row(spark):
    """Three million rows, several columns, two groups of very different size, partitions that are merged while the query runs."""
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    df = spark.range(3_000_000).select(F.xxhash64("id").alias("k"), F.when(F.col("id") % 100 == 0, "b").otherwise("a").alias("g"), F.col("id").cast("string").alias("t"), "id")
    check = lambda d, c: d.agg(F.count("*"), F.count_distinct(c), F.min(c), F.max(c)).first()
    assert tuple(check(requests.numbered(df, "k"), "doc_id")) == (3_000_000, 3_000_000, 0, 2_999_999)
    inner = requests.numbered(df, "k", "g")
    assert tuple(check(inner.where("g = 'b'"), "doc_id")) == (30_000, 30_000, 0, 29_999)
    assert tuple(check(inner.where("g = 'a'"), "doc_id")) == (2_970_000, 2_970_000, 0, 2_969_999)


def test_all_correct_stderr(spark):
    df = spark.createDataFrame([(1, 1, 1, 1), (1, 1, 0, 0), (2, 2, 1, 0), (3, 2, 1, 1), (4, 3, 0, 0)], "p INT, q INT, label INT, pred INT")
    assert A.all_correct(df, ["p", "q"], F.col("label"), F.col("pred")).first().acc_all == 0.75
    assert A.all_correct_stderr(df, ["q"], F.col("label"), F.col("pred")).first().acc_all_stderr == pytest.approx(statistics.stdev([1, 0, 1]) / 3**0.5)


def test_text_corpora(spark):
    df = spark.createDataFrame([(1, 1, "a b c d e", "a b c d e"), (1, 2, "f g h i j", "f g h i j")], "k INT, i INT, r STRING, p STRING")
    r, p = F.split("r", " "), F.split("p", " ")
    assert A.corpus_bleu(df, ["k"], F.col("r"), F.col("p")).first().bleu == pytest.approx(100)
    assert A.corpus_ter(df, ["k"], F.col("r"), F.col("p")).first().ter == 0
    assert captions.corpus_chrf(df, ["k"], F.col("r"), F.col("p")).first().chrf == pytest.approx(100)
    assert captions.cider(df, "i", r, p).first().cider == pytest.approx(10)
    moved = spark.createDataFrame([(1, "a b c d", "c d a b")], "k INT, r STRING, p STRING")
    assert A.corpus_ter(moved, ["k"], F.col("r"), F.col("p")).first().ter == pytest.approx(0.25)


def test_summed_metrics_and_their_resamples(spark):
    rng = random.Random(3)
    words = [" ".join(rng.choice("abcdefg") for _ in range(8)) for _ in range(400)]
    near = [" ".join(x if rng.random() < 0.8 else "z" for x in w.split()) for w in words]
    rows = [(i, "k", w, n, rng.choice([0, 1]), rng.choice([0, 1]), rng.random()) for i, (w, n) in enumerate(zip(words, near))]
    df = spark.createDataFrame(rows, "i INT, k STRING, r STRING, p STRING, g INT, q INT, v DOUBLE")

    def resampled(metric, gold, predicted, table=df):
        return A.bootstrap_summed_stderr(metric, table, ["k"], "i", F.col(gold), F.col(predicted), 200).first()

    # brute force: the statistic of multinomial resamples of the rows
    hits = [(int(g == q == 1), int(g != 1 and q == 1), int(g == 1 and q != 1)) for *_, g, q, _ in rows]
    f1 = lambda xs: 2 * sum(x[0] for x in xs) / sum(2 * x[0] + x[1] + x[2] for x in xs)
    want = statistics.stdev(f1(rng.choices(hits, k=len(hits))) for _ in range(400))
    got = resampled("f1", "g", "q")
    assert got.k == "k" and got.resamples == 200 and got.stderr == pytest.approx(want, rel=0.2)
    assert resampled("f1", "g", "q", df.repartition(5)).stderr == pytest.approx(got.stderr)
    assert resampled("mean", "g", "v").stderr == pytest.approx(statistics.stdev(r[-1] for r in rows) / 20, rel=0.2)
    assert 0 < resampled("perplexity", "g", "v").stderr < 1
    for metric in ("bleu", "chrf", "ter"):
        assert 0 < resampled(metric, "r", "p").stderr < 5
    assert A.bootstrap_summed_stderr("bleu", df.limit(0), ["k"], "i", F.col("r"), F.col("p"), 10).count() == 0
    only = A.bootstrap_summed_stderr("mean", df.withColumn("k", F.lit(None).cast("string")), ["k"], "i", F.col("g"), F.col("v"), 10).first()
    assert only.k is None and only.resamples == 10
    mcc = A.bootstrap_matthews_stderr(df, ["k"], "g", "q", 200).first()
    assert mcc.resamples == 200 and mcc.stderr == pytest.approx(1 / 20, rel=0.25)  # of independent classes about 1 / sqrt(n)


def test_poisson_weights():
    import numpy as np

    w = A.poisson_weights(np.arange(20_000, dtype=np.int64) * 7919, 20)
    assert w.shape == (20_000, 20) and w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03


def test_captions(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 90))) for _ in range(60)]

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b, 1):
                row[j] = last[j - 1] + 1 if x == y else max(row[j - 1], last[j])
        return row[-1]

    pairs = list(zip(texts, texts[1:])) + [(None, "a"), ("a", None), ("", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i INT, r STRING, p STRING")
    got = [x.s for x in df.select("i", captions.rouge_l(F.col("r"), F.col("p")).alias("s")).orderBy("i").collect()]
    for (r, p), s in zip(pairs, got):
        a, b = (r or "").split(), (p or "").split()
        n = longest(a, b)
        want = 0 if not n else (1 + 1.44) * (n / len(b)) * (n / len(a)) / (n / len(a) + 1.44 * n / len(b))
        assert s == pytest.approx(want), (r, p)
    same = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, "a b", "b a")], "k INT, r STRING, p STRING")
    bleus = {x.k: x for x in captions.caption_bleus(same, ["k"], F.col("r"), F.col("p")).collect()}
    assert list(bleus[1])[1:] == pytest.approx([1] * 4) and bleus[2].bleu_1 == pytest.approx(1) and bleus[2].bleu_2 < 1e-6


def test_requests_are_joined_by_name(spark):
    asked = spark.createDataFrame([("t", 1, 0, 0), ("t", 1, 0, 1), ("u", 1, 0, 0)], "task STRING, doc_id INT, idx INT, repeat INT")
    there = spark.createDataFrame([("t", 1, 0, 1, "b"), ("t", 1, 0, 1, "b"), ("u", 1, 0, 0, "c"), ("x", 1, 0, 0, "d")], "task STRING, doc_id INT, idx INT, repeat INT, response STRING")
    got = {(r.task, r.repeat): r.response for r in requests.answered(asked, there).collect()}
    assert got == {("t", 0): None, ("t", 1): "b", ("u", 0): "c"}
    rows = spark.createDataFrame([(1, 5, "late"), (1, 2, "early"), (2, None, "only"), (1, None, "never"), (None, 1, "nobody")], "k INT, at INT, v STRING")
    assert {r.k: r.v for r in curate.kept_first(rows, "k", "at").collect()} == {1: "early", 2: "only", None: "nobody"}
    golds = spark.createDataFrame([(1, [1, 9], 2), (9, [9], 2), (0, None, 2)], "p INT, g ARRAY<INT>, n INT")
    hits = golds.select(scoring.in_gold(F.col("p"), scoring.gold_indices(F.col("g"), F.col("n"))).alias("x"), "p").collect()
    assert {r.p: r.x for r in hits} == {1: 1.0, 9: 0.0, 0: 0.0}


def test_history_keeps_nulls_and_order(spark):
    df = spark.createDataFrame([("t", 2, None), ("t", 1, "a"), ("t", 3, "c"), ("u", 1, "z")], "t STRING, s INT, v STRING")
    got = {(r.t, r.s): r.prev_v for r in history.with_history(df, "t", "s", ["v"]).collect()}
    assert got == {("t", 1): [], ("t", 2): ["a"], ("t", 3): ["a", None], ("u", 1): []}
    kept = history.within_budget(df.na.fill("bb", ["v"]), "t", "s", F.length("v"), 3).collect()
    assert {(r.t, r.s) for r in kept} == {("t", 3), ("u", 1)}


def test_rolling_windows_cover_once(spark):
    for n in (0, 1, 5, 6, 17):
        df = spark.createDataFrame([(list(range(n)),)], "x ARRAY<INT>")
        w = df.select(history.rolling_windows(F.col("x"), 5, 2)).first()[0]
        assert [i for x in w for i in range(x["start"], x["stop"])] == list(range(n))
        assert all(x["stop"] - x["from"] <= 6 for x in w)


def test_numbering_does_not_depend_on_partitions(spark):
    df = spark.range(100).withColumn("k", F.concat(F.lit("k"), F.lpad((F.col("id") * 37 % 100).cast("string"), 3, "0")))
    a, b = ({r.k: r.doc_id for r in requests.numbered(df.repartition(n), "k").collect()} for n in (1, 7))
    assert a == b and sorted(a.values()) == list(range(100)) and a["k000"] == 0
    assert requests.shard(requests.limited(requests.numbered(df, "k"), 0.1), 1, 3).count() == 3


def test_few_shot_leaves_itself_out(spark):
    df = spark.createDataFrame([(i, "g", f"t{i}") for i in range(6)], "k INT, g STRING, t STRING")
    for r in requests.few_shot(df, df, 3, "g", "k", F.col("t")).collect():
        parts = r.context.split("\n\n")
        assert len(parts) == 4 and parts[-1] == r.t and r.t not in parts[:-1]


def test_templates_batches_and_cache(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, "a")], "k INT, t STRING").withColumn("g", F.lit(0))
    assert df.select(requests.template("<{{k}}:{{t}}>").alias("x")).first().x == "<1:ab>"
    got = {r.k: r.batch for r in requests.batches(df, "g", F.length("t"), 2, "k").collect()}
    assert got == {2: 0, 1: 0, 3: 1}
    assert requests.misses(df, df.where("k = 1"), "k").count() == 2
    with pytest.raises(Exception):
        df.select(requests.template("{{nope}}")).collect()


def test_scoring(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], [1, 4, 2], "b", ["a", "b"])], "l ARRAY<DOUBLE>, n ARRAY<INT>, g STRING, c ARRAY<STRING>")
    row = df.select(scoring.argmax(F.col("l")), scoring.argmax(scoring.by_length(F.col("l"), F.col("n"))), scoring.gold_index(F.col("g"), F.col("c")), scoring.gold_index(F.lit("q"), F.col("c"))).first()
    assert tuple(row) == (1, 2, 1, -100)


def test_curation(spark):
    df = spark.createDataFrame([([("human", "<img>p.png</img>\nhi (x)"), ("gpt", "a long answer"), ("system", None)],)], "c ARRAY<STRUCT<sender: STRING, content: STRING>>")
    m = df.withColumn("m", curate.chat(F.col("c")))
    assert [x.role for x in m.first().m] == ["user", "assistant", "system"]
    x = m.select(curate.picture_and_text(F.col("m")[0]["content"]).alias("x"), curate.ref_tagged(F.col("m")[0]["content"], F.col("m")[1]["content"]).alias("t"), *curate.masked(F.col("m"), 8)).first()
    assert tuple(x.x) == ("p.png", "hi (x)") and x.t.endswith("hi <ref>(x)")
    assert list(x[3]) == [-100, -100, 1, 4, 6, -100, -100, -100]
    assert spark.range(1).select(curate.spaced(F.lit(9), 5)).first()[0] == [0, 2, 4, 6, 8]
    got = spark.createDataFrame([("Qwen-GPT",), ("SeeClick",), ("other",)], "m STRING").select(curate.prompt_for(F.col("m"), F.lit("Tap."), F.lit(0))).collect()
    assert 'the description "Tap"?' in got[0][0] and got[1][0].endswith('the command "Tap" (with point)?') and got[2][0].endswith('(with point). This element is used for "Tap"')


def test_tasks(spark, monkeypatch):
    for known in (tasks.METRICS, tasks.TASKS, tasks.GROUPS):
        monkeypatch.setattr(tasks, next(n for n, v in vars(tasks).items() if v is known), {})
    tasks.metric("hit")(lambda df: F.col("response") == F.col("target"))
    base = tasks.Task("one_test", "Q: {{q}}", "a", metrics={"hit": "mean"}, filters=(("lowercase", {}), ("take_first", {})))
    tasks.register(base, "all"), tasks.register(base.extended(name="two_test", where="k > 1"), "all")
    assert tasks.matching(["*_test"]) == ["one_test", "two_test"]
    docs = spark.createDataFrame([(1, "x", "yes"), (2, "y", "no")], "k INT, q STRING, a STRING")
    asked = tasks.requests_of(tasks.TASKS["two_test"], docs)
    assert [r.prompt for r in asked.collect()] == ["Q: y"]
    answered = {n: tasks.requests_of(tasks.TASKS[n], docs).withColumn("resps", F.array(F.lit("YES"))) for n in ("one_test", "two_test")}
    got = {r.task: r.shown for r in tasks.evaluate_all(["*_test"], answered).collect()}
    assert got["one_test"] == 0.5 and got["two_test"] == 0.0 and got["all"] == pytest.approx(1 / 3)
    assert "|one_test|hit|none|" in report.markdown(tasks.evaluate(tasks.TASKS["one_test"], answered["one_test"]))


def test_task_pipelines_and_resampled_errors(spark, monkeypatch):
    monkeypatch.setattr(tasks, "METRICS", {"value": lambda df: F.col("response").try_cast("double")})
    docs = spark.createDataFrame([(i, [f"a {i}", str(i)]) for i in range(50)], "i INT, resps ARRAY<STRING>")
    steps = {"none": (("take_first", {}),), "number": (("regex", {"pattern": r"\d+"}), ("take_first", {}))}
    task = tasks.Task("t", "i", metrics={"value": "median"}, pipelines=steps)
    got = {r["filter"]: r for r in tasks.evaluate(task, docs, row="i").collect()}
    assert got["none"].n == 0 and got["none"].shown is None and got["none"].stderr is None
    assert got["number"].n == 50 and got["number"].shown in (24.0, 25.0) and 0 < got["number"].stderr < 10
    small = docs.withColumn("resps", F.array((F.col("i") / 50).cast("string")))
    one = tasks.evaluate(tasks.Task("t", "i", metrics={"value": "perplexity"}), small, row="i").first()
    assert 1 < one.shown < 2 and 0 < one.stderr < 0.2
    assert tasks.evaluate(tasks.Task("t", "i", metrics={"value": "median"}), docs).first().stderr is None


def test_sources(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"args": {}, "logs": [{"doc_id": 1, "v": 2.0}, {"doc_id": 2, "v": 3.0}]}')
    log = io.eval_log(spark, str(tmp_path / "log.json"))
    assert log.count() == 2
    io.write_samples(log.withColumn("task", F.lit("t")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    io.write_samples(log.withColumn("task", F.lit("t")), str(tmp_path / "out"), arguments={"limit": 2}, configs={"m": {"scale": 100}})
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert '"limit": 2' in (tmp_path / "out" / "_run.json").read_text()
    io.write_splits(log.withColumn("split", F.when(F.col("doc_id") == 1, "test").otherwise("val")), str(tmp_path / "splits"))
    assert io.split_of(io.dataset(spark, str(tmp_path / "splits"))).select("doc_id").collect()[0][0] == 1
    df = spark.createDataFrame([("aGk=", bytearray(b"x")), ("?", None)], "t STRING, b BINARY")
    assert [r[0] for r in df.select(io.decoded(F.col("t"))).collect()] == [bytearray(b"hi"), None]
    assert io.without_pictures(df).columns == ["t"]
    assert io.split_of(df.withColumn("split", F.lit("val"))).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i // 10:02d}:{i % 10 * 6:02d}:00", "m", i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "response_id BIGINT, at STRING, model STRING, hit INT").withColumn("logged_at", F.to_timestamp("at")).drop("at")
    df.union(df.limit(10)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = scores.windowed_scores(scores.distinct_responses(stream), ["model"], "hit", "logged_at", late=None)
    q = out.writeStream.format("memory").queryName("scores_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(r.start, r.n, r["mean"]) for r in spark.table("scores_out").collect()}
    want = {(r.start, r.n, r["mean"]) for r in scores.windowed_scores(df, ["model"], "hit", "logged_at").collect()}
    assert got <= want and len(got) > len(want) / 2  # the last windows wait for the watermark


def test_selection_and_cache(spark):
    df = spark.range(10).withColumnRenamed("id", "doc_id")
    assert requests.selected(df, df.where("doc_id IN (2, 5)")).count() == 2 and requests.first(df, 4).count() == 4
    with pytest.raises(ValueError):
        requests.first(df, 11)
    cache, fresh = (spark.createDataFrame(rows, "doc_id BIGINT, response STRING") for rows in ([(1, "a"), (1, "a")], [(1, "z"), (2, "b")]))
    got = {r.doc_id: r.response for r in requests.filled(df.limit(4), cache, fresh, "doc_id").collect()}
    assert got == {0: None, 1: "a", 2: "b", 3: None}


def test_few_shot_draws_for_each_document(spark):
    df = spark.createDataFrame([(i, "g" if i < 40 else "h", f"t{i}") for i in range(42)], "k INT, g STRING, t STRING")
    got = {r.k: r.context.split("|") for r in requests.few_shot(df, df, 2, "g", "k", F.col("t"), description="D", joined="|", target=F.lit("yes")).collect()}
    assert all(c[0] == "D" and c[-1] == f"t{k}" and f"t{k} yes" not in c for k, c in got.items())
    assert all(len(c) == (4 if k < 40 else 3) for k, c in got.items())
    assert len({tuple(c[1:3]) for k, c in got.items() if k < 40}) > 10


def test_reports(spark):
    members = spark.createDataFrame([(None, "b"), (None, "a"), ("a", "y"), ("a", "x"), ("b", "x")], "parent STRING, name STRING")
    rows = report.hierarchy(members).orderBy("position").collect()
    assert [r.shown for r in rows] == ["a", " - x", " - y", "b", " - x"]
    with pytest.raises(ValueError):
        report.hierarchy(members.union(spark.createDataFrame([("x", "a")], members.schema)), 5)
    text = spark.createDataFrame([("t", "one: 1\ntwo: 2 / 3")], "task STRING, v STRING")
    assert [tuple(r) for r in report.lines_of(text, ["task"], "v").collect()] == [("t", "one", "1"), ("t", "two", "2 / 3")]


def test_results_are_written(spark, tmp_path):
    import json

    df = spark.createDataFrame([("t", "acc", "none", 50.0, None)], "task STRING, metric STRING, filter STRING, shown DOUBLE, stderr DOUBLE")
    io.write_results(df, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"t": {"acc,none": 50.0, "acc_stderr,none": None}}


def test_tables_are_released(spark):
    from loomscope import session

    t = session.written(spark.range(3), "some")
    assert t.count() == 3 and session.release(spark) >= 1 and session.release(spark) == 0


def test_words_as_translation_scores_split_them(spark):
    from loomscope.functions import text

    got = spark.range(1).select(text.tokenised_13a(F.lit('Hello, (world) 3.5 &quot;x&quot; end.'))).first()[0]
    assert got == 'Hello , ( world ) 3.5 " x " end .'
