"""Grounding: responses joined with the records they locate, parsed, scored and sliced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscope.functions import geometry as G
from loomscope.functions import parse as P
from loomscope.operators import aggregates as A
from loomscope.operators import filters, report
from loomscope.queries.registry import query
from loomscope.session import table, written

#: Scale of the coordinates of each model; other models have the default.
SCALES, DEFAULT_SCALE = {"grounder_a": 100, "grounder_b": 1000}, 100
MAX_BINS = 30


def records(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The distinct records with some columns, their box in parts of the picture's size."""
    r = table(spark, d, "func_records").select("rec_id", "unnormalized_box", "image_size", *columns).distinct()
    r = r.withColumn("box", G.normalised(F.col("unnormalized_box"), F.col("image_size"))).drop("unnormalized_box", "image_size")
    return r.withColumn("device", F.lower(F.trim("device"))) if "device" in columns else r


def responses(spark: SparkSession, d: str) -> DataFrame:
    """The distinct responses with the coordinates they name."""
    r = table(spark, d, "eval_responses").select("response_id", "rec_id", "model", "response").distinct()
    scales = F.create_map(*(F.lit(x) for kv in SCALES.items() for x in kv))
    scale = F.coalesce(F.try_element_at(scales, F.col("model")), F.lit(DEFAULT_SCALE))
    return r.withColumn("coords", P.coordinates(F.col("response"), scale))


def scored(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Responses with some columns of their record, the hit flag and the distance from the middle of the record's box."""
    s = responses(spark, d).drop("response").join(records(spark, d, *columns), "rec_id").where("box IS NOT NULL")
    return s.withColumns(
        {
            "hit": G.centre_hit(F.col("box"), F.col("coords")).cast("int"),
            "dist": F.when(F.col("coords").isNotNull(), G.distance(G.centre(F.col("coords")), G.centre(F.col("box")))),
        }
    )


def with_medians(groups: DataFrame, s: DataFrame, keys: list[str]) -> DataFrame:
    """``groups`` with the exact median distance of each group of ``s``."""
    m = A.medians(s, keys, "dist", "median_dist").select(*(F.col(k).alias(f"of_{k}") for k in keys), F.round("median_dist", 6).alias("median_dist"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return groups.join(m, on, "left").select(*groups.columns, "median_dist")


R_SQL = """
r0 AS (SELECT DISTINCT rec_id, split, source, site, func, unnormalized_box, image_size, elem_text, elem_role, elem_tag, device FROM func_records),
r1 AS (SELECT rec_id, split, source, site, func, image_size, elem_text, elem_role, elem_tag, lower(trim(device)) device, unnormalized_box b,
  TRY_CAST(split_part(image_size, 'x', 1) AS DOUBLE) w, TRY_CAST(split_part(image_size, 'x', 2) AS DOUBLE) h FROM r0),
r AS (SELECT *, CASE WHEN b IS NOT NULL AND w > 0 AND h > 0 THEN [b[1]/w, b[2]/h, b[3]/w, b[4]/h] END box FROM r1)"""

_NUM = r"'^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$'"


def _floats(parts: str) -> str:
    return f"CASE WHEN len(list_filter({parts}, lambda p: NOT coalesce(regexp_matches(p, {_NUM}), false))) = 0 THEN list_transform({parts}, lambda p: CAST(trim(p) AS DOUBLE)) END"


E_SQL = rf"""
e0 AS (SELECT DISTINCT response_id, rec_id, model, prompt, response FROM eval_responses),
e1 AS (SELECT *, CASE model WHEN 'grounder_b' THEN 1000.0 ELSE 100.0 END sc,
  CASE WHEN contains(response, 'action') THEN trim(split_part(response, 'action', 2), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE response END t FROM e0),
e2 AS (SELECT *, regexp_extract_all(t, '\[(.*?)\]', 1) inn, regexp_split_to_array(t, '\[.*?\]') pieces,
  string_split(substr(t, instr(t, '[[') + 2, greatest(instr(t, ']]') - instr(t, '[[') - 2, 0)), ',') dbl,
  regexp_extract_all(t, '\((\d+,\d+)\),\((\d+,\d+)\)', 1) c1, regexp_extract_all(t, '\((\d+,\d+)\),\((\d+,\d+)\)', 2) c2 FROM e1),
e3 AS (SELECT *, list_filter(list_transform(range(1, len(inn) + 1), lambda i: {{'i': i, 'v': {_floats("string_split(inn[i], ',')")}}}), lambda x: x.v IS NOT NULL) tried FROM e2),
e4 AS (SELECT *, tried[-1].v lv, tried[-1].i li, {_floats("string_split(inn[tried[-1].i - 1], ', ')")} ov FROM e3),
e5 AS (SELECT *, CASE WHEN contains(t, '<box>') THEN CASE WHEN len(c1) > 0 THEN list_transform(string_split(c1[-1] || ',' || c2[-1], ','), lambda v: CAST(v AS DOUBLE)) END
  ELSE list_transform(regexp_extract_all(t, '-?\d+\.?\d*'), lambda v: CAST(v AS DOUBLE)) END gen FROM e4),
e6 AS (SELECT *, CASE WHEN contains(t, '[[') AND instr(t, ']]') > 0 THEN list_transform({_floats("dbl")}, lambda x: x / sc)
  WHEN contains(t, '[[') THEN gen
  WHEN contains(t, '[') AND len(inn) > 0 THEN CASE WHEN len(lv) = 2 AND li > 1 AND length(pieces[li]) < 30 AND len(ov) = 2 THEN [(lv[1] + ov[1]) / 2, (lv[2] + ov[2]) / 2] ELSE lv END
  WHEN contains(t, '[') THEN gen
  WHEN starts_with(t, '<box>') THEN list_transform(regexp_extract_all(t, '\d+'), lambda v: CAST(v AS DOUBLE)) ELSE gen END found FROM e5),
e AS (SELECT response_id, rec_id, model, prompt, response, CASE WHEN len(found) IN (2, 4) THEN CASE WHEN list_max(found) > 1 THEN list_transform(found, lambda x: x / sc) ELSE found END END coords FROM e6)"""

S_SQL = f"""{R_SQL},{E_SQL},
s0 AS (SELECT r.*, e.response_id, e.model, e.prompt, e.response, e.coords,
  CASE len(coords) WHEN 2 THEN coords[1] WHEN 4 THEN (coords[1] + coords[3]) / 2 END px, CASE len(coords) WHEN 2 THEN coords[2] WHEN 4 THEN (coords[2] + coords[4]) / 2 END py
  FROM e JOIN r USING (rec_id) WHERE box IS NOT NULL),
s AS (SELECT *, CASE WHEN px BETWEEN box[1] AND box[3] AND py BETWEEN box[2] AND box[4] THEN 1 ELSE 0 END hit,
  sqrt(power(px - (box[1] + box[3]) / 2, 2) + power(py - (box[2] + box[4]) / 2, 2)) dist,
  CASE WHEN len(coords) = 4 THEN greatest(0.0, least(coords[3], box[3]) - greatest(coords[1], box[1])) * greatest(0.0, least(coords[4], box[4]) - greatest(coords[2], box[2])) ELSE 0.0 END inter,
  CASE WHEN len(coords) = 4 THEN (coords[3] - coords[1]) * (coords[4] - coords[2]) + (box[3] - box[1]) * (box[4] - box[2]) END areas FROM s0),
i AS (SELECT *, CASE WHEN len(coords) = 4 THEN inter / nullif(areas - inter, 0) ELSE 0.0 END iou FROM s)"""


@query(f"WITH {S_SQL} SELECT model, device, round(avg(hit), 6) center_acc, count(*) n FROM s GROUP BY GROUPING SETS ((model), (model, device))")
def center_acc_by_device(spark, d):
    """Centre accuracy of each model, overall and by device."""
    s = scored(spark, d, "device")
    out = s.groupingSets([["model"], ["model", "device"]], "model", "device")
    return out.agg(F.round(F.avg("hit"), 6).alias("center_acc"), F.count("*").alias("n"))


@query(f"WITH {E_SQL} SELECT response_id, len(coords) n_coords, round(coords[1], 6) x1, round(coords[2], 6) y1, round(coords[3], 6) x2, round(coords[4], 6) y2 FROM e")
def parse_coordinates(spark, d):
    """Every response as a point or box; null where it names none."""
    n = F.col("coords")
    return responses(spark, d).select("response_id", F.when(n.isNotNull(), F.size(n)).cast("bigint").alias("n_coords"), *(F.round(G.at(n, i), 6).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))))


@query(r"""WITH e AS (SELECT DISTINCT response_id, response FROM eval_responses),
x AS (SELECT *, regexp_extract_all(response, '\((\d+,\d+)\),\((\d+,\d+)\)', 1) c1, regexp_extract_all(response, '\((\d+,\d+)\),\((\d+,\d+)\)', 2) c2 FROM e)
SELECT response_id, TRY_CAST(nullif(regexp_extract(response, '<point>\((\d+),(\d+)\)</point>', 1), '') AS DOUBLE) tag_x, TRY_CAST(nullif(regexp_extract(response, '<point>\((\d+),(\d+)\)</point>', 2), '') AS DOUBLE) tag_y,
CAST(split_part(c1[-1], ',', 1) AS DOUBLE) left_x, CAST(split_part(c2[-1], ',', 2) AS DOUBLE) bottom_y,
CASE WHEN response IS NULL THEN NULL ELSE coalesce(TRY_CAST(nullif(regexp_extract(response, '\[\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*\]', 1), '') AS DOUBLE), 0.0) END first_of_four,
regexp_extract(response, '"action_type": "([a-z_]+)"', 1) action_type FROM x""")
def parse_dialects(spark, d):
    """What single-notation parsers find: point tag, last corners, list of four, action type."""
    e, r = table(spark, d, "eval_responses").select("response_id", "response").distinct(), F.col("response")
    corners, tag = P.last_corners(r), P.point_tag(r)
    kind = F.when(r.isNotNull(), F.coalesce(P.action_fields(r)["action_type"], F.lit("")))
    return e.select(
        "response_id", G.at(tag, 0).alias("tag_x"), G.at(tag, 1).alias("tag_y"), G.at(corners, 0).alias("left_x"), G.at(corners, 3).alias("bottom_y"),
        F.when(r.isNotNull(), G.at(P.float_list(r), 0)).alias("first_of_four"), kind.alias("action_type"),
    )


@query(f"""WITH {S_SQL} SELECT device, elem_role, CASE WHEN coords IS NULL THEN 'invalid' WHEN hit = 1 THEN 'correct' ELSE 'wrong' END status, count(*) n FROM s GROUP BY ALL""")
def status_by_role(spark, d):
    """Correct, wrong and unreadable responses by device and role."""
    status = F.when(F.col("coords").isNull(), "invalid").when(F.col("hit") == 1, "correct").otherwise("wrong")
    return scored(spark, d, "device", "elem_role").groupBy("device", "elem_role", status.alias("status")).agg(F.count("*").alias("n"))


ACC_SQL = ", ".join(f"round(avg(CASE WHEN iou >= 0.{k} THEN 1.0 ELSE 0.0 END), 6) acc_{k}" for k in (1, 3, 5, 7, 9))


@query(f"WITH {S_SQL} SELECT model, count(*) n, round(avg(iou), 6) iou, {ACC_SQL} FROM i WHERE len(coords) = 4 GROUP BY model")
def iou_thresholds(spark, d):
    """Mean intersection over union of predicted boxes and accuracy at five thresholds."""
    s = scored(spark, d).where(F.size("coords") == 4).withColumn("iou", G.iou(F.col("coords"), F.col("box")))
    return s.groupBy("model").agg(
        F.count("*").alias("n"), F.round(F.avg("iou"), 6).alias("iou"),
        *(F.round(F.avg((F.col("iou") >= k / 10).cast("double")), 6).alias(f"acc_{k}") for k in (1, 3, 5, 7, 9)),
    )


@query(f"WITH {S_SQL} SELECT device, round(avg(CASE WHEN iou >= 0.5 THEN 1.0 ELSE 0.0 END), 6) iou_acc, count(*) n FROM i GROUP BY GROUPING SETS ((), (device))")
def region_iou_acc(spark, d):
    """Share of responses whose box covers the region (IoU of 0.5 or more), overall and by device."""
    s = scored(spark, d, "device").withColumn("ok", (F.coalesce(G.iou(F.col("coords"), F.col("box")), F.lit(0.0)) >= 0.5).cast("double"))
    return s.groupingSets([[], ["device"]], "device").agg(F.round(F.avg("ok"), 6).alias("iou_acc"), F.count("*").alias("n"))


SLICES = [(p, k) for p in ("mobile", "desktop", "web") for k in ("text", "icon")]


@query(f"""WITH {S_SQL}, k AS (SELECT hit, CASE WHEN source LIKE '%ios%' OR source LIKE '%android%' THEN 'mobile' WHEN source LIKE '%macos%' OR source LIKE '%windows%' THEN 'desktop' ELSE 'web' END platform,
CASE WHEN elem_text IS NOT NULL THEN 'text' ELSE 'icon' END kind FROM s),
f AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{k}')" for p, k in SLICES)}) v(platform, kind))
SELECT f.platform, f.kind, coalesce(round(avg(hit), 6), 0.0) acc, count(hit) n FROM f LEFT JOIN k USING (platform, kind) GROUP BY ALL
UNION ALL SELECT 'all', 'all', round(avg(hit), 6), count(*) FROM k""")
def platform_slices(spark, d):
    """Accuracy of six fixed slices of platform and kind of element (0 if empty), and overall."""
    source = F.col("source")
    platform = F.when(source.rlike("ios|android"), "mobile").when(source.rlike("macos|windows"), "desktop").otherwise("web")
    kind = F.when(F.col("elem_text").isNotNull(), "text").otherwise("icon")
    s = scored(spark, d, "source", "elem_text").groupBy(platform.alias("platform"), kind.alias("kind")).agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    s = written(s, "slices")  # six rows
    fixed = spark.createDataFrame(SLICES, "platform STRING, kind STRING")
    n = F.coalesce("n", F.lit(0))
    each = fixed.join(s, ["platform", "kind"], "left").select("platform", "kind", F.coalesce(F.round(F.col("hits") / F.col("n"), 6), F.lit(0.0)).alias("acc"), n.alias("n"))
    total = s.agg(F.lit("all").alias("platform"), F.lit("all").alias("kind"), F.round(F.sum("hits") / F.sum("n"), 6).alias("acc"), F.sum("n").alias("n"))
    return each.union(total)


@query(f"WITH {S_SQL} SELECT device, elem_role, round(avg(hit), 6) acc, count(*) n, round(median(dist), 6) median_dist FROM s GROUP BY device, elem_role")
def elem_type_acc(spark, d):
    """Accuracy and median distance by device and role."""
    s = written(scored(spark, d, "device", "elem_role").select("device", "elem_role", "hit", "dist"), "scored")
    one = s.groupBy("device", "elem_role").agg(F.round(F.avg("hit"), 6).alias("acc"), F.count("*").alias("n"))
    return with_medians(one, s, ["device", "elem_role"])


@query(f"""WITH {S_SQL}, a AS (SELECT hit, (box[3] - box[1]) * (box[4] - box[2]) area FROM s)
SELECT bin, round(avg(hit), 6) acc, count(*) n FROM (SELECT hit, CASE WHEN area < 0 THEN NULL WHEN area < 0.002 THEN 0 WHEN area < 0.004 THEN 1 WHEN area < 0.006 THEN 2 WHEN area < 0.008 THEN 3 WHEN area < 0.01 THEN 4 WHEN area < 1e6 THEN 5 END bin FROM a) GROUP BY bin""")
def area_bin_acc(spark, d):
    """Accuracy by the area of the element, in half-open bins."""
    area, bin_ = G.area(F.col("box")), F.lit(None).cast("int")
    for k, edge in reversed(list(enumerate((0.002, 0.004, 0.006, 0.008, 0.01, 1e6)))):
        bin_ = F.when(area < edge, k).otherwise(bin_)
    return scored(spark, d).groupBy(F.when(area >= 0, bin_).alias("bin")).agg(F.round(F.avg("hit"), 6).alias("acc"), F.count("*").alias("n"))


@query(f"""WITH {S_SQL}, m AS (SELECT min(round(dist, 9)) lo, max(round(dist, 9)) hi FROM s WHERE dist IS NOT NULL)
SELECT CAST(least(floor((round(dist, 9) - lo) / nullif(hi - lo, 0) * 30), 29) AS BIGINT) bin, count(*) n FROM s, m WHERE dist IS NOT NULL GROUP BY bin""")
def distance_histogram(spark, d):
    """Distances in thirty equal bins from the least to the largest."""
    s = scored(spark, d).where("dist IS NOT NULL").select(F.round("dist", 9).alias("dist"))
    edges = s.agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    part = F.try_divide(F.col("dist") - F.col("lo"), F.col("hi") - F.col("lo")) * MAX_BINS
    return s.join(F.broadcast(edges)).groupBy(F.least(F.floor(part), F.lit(MAX_BINS - 1)).alias("bin")).agg(F.count("*").alias("n"))  # edges: one row


@query(f"WITH {S_SQL} SELECT split, elem_role, round(avg(hit), 6) acc, count(*) n, GROUPING(split) + GROUPING(elem_role) AS level FROM s GROUP BY ROLLUP (split, elem_role)")
def task_rollup_acc(spark, d):
    """Accuracy by split and role, by split, and overall."""
    level = (F.grouping("split") + F.grouping("elem_role")).cast("bigint")
    return scored(spark, d, "split", "elem_role").rollup("split", "elem_role").agg(F.round(F.avg("hit"), 6).alias("acc"), F.count("*").alias("n"), level.alias("level"))


@query(f"""WITH {S_SQL}, m AS (SELECT rec_id, model, max(hit) hit FROM s GROUP BY rec_id, model)
SELECT a.model model_a, b.model model_b, count(*) common, CAST(sum(CASE WHEN a.hit = 1 AND b.hit = 0 THEN 1 ELSE 0 END) AS BIGINT) only_a, CAST(sum(CASE WHEN a.hit = 1 AND b.hit = 1 THEN 1 ELSE 0 END) AS BIGINT) both_right
FROM m a JOIN m b ON a.rec_id = b.rec_id AND a.model <> b.model GROUP BY ALL""")
def model_compare(spark, d):
    """For each two models: records both answered, those only the first got right, those both got right."""
    m = scored(spark, d).groupBy("rec_id", "model").agg(F.max("hit").alias("hit"))
    a, b = m.select("rec_id", F.col("model").alias("model_a"), F.col("hit").alias("a")), m.select("rec_id", F.col("model").alias("model_b"), F.col("hit").alias("b"))
    both = a.join(b, "rec_id").where("model_a <> model_b")
    return both.groupBy("model_a", "model_b").agg(F.count("*").alias("common"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both_right"))


@query(f"WITH {S_SQL} SELECT model, round(avg(hit), 6) mean, round(stddev_samp(hit) / sqrt(count(*)), 6) stderr, round(stddev_pop(hit), 6) pop, round(median(dist), 6) median_dist, count(*) n FROM s GROUP BY model")
def mean_stderr_by_model(spark, d):
    """Mean, standard error and deviation of the hits, true median of the distances."""
    s = written(scored(spark, d).select("model", "hit", "dist"), "scored")
    one = s.groupBy("model").agg(
        F.round(F.avg("hit"), 6).alias("mean"), F.round(A.mean_stderr(F.col("hit")), 6).alias("stderr"), F.round(F.stddev_pop("hit"), 6).alias("pop"), F.count("*").alias("n"),
    )
    return with_medians(one, s, ["model"])


@query(f"""WITH {S_SQL}, t AS (SELECT model, split, avg(hit) m, stddev_samp(hit) / sqrt(count(*)) se, CAST(count(*) AS DOUBLE) n FROM s GROUP BY model, split),
o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY split) k FROM t),
a AS (SELECT model, m m1, coalesce(se, 0) s1, n n1 FROM o WHERE k = 1), b AS (SELECT model, m m2, coalesce(se, 0) s2, n n2 FROM o WHERE k = 2),
x AS (SELECT model, m1, n1, s1, coalesce(m2, m1) m2, coalesce(n2, 0) n2, s2 FROM a LEFT JOIN b USING (model))
SELECT model, round((m1 * n1 + m2 * n2) / (n1 + n2), 6) mean, round(CASE WHEN n2 = 0 THEN s1 ELSE sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 1) + n1 * n2 / ((n1 + n2) * (n1 + n2 - 1)) * power(m1 - m2, 2)) END, 6) stderr, n1 + n2 n FROM x""")
def group_pooled_stderr(spark, d):
    """Splits of a model pooled to one mean and standard error, in the order of their names."""
    one = scored(spark, d, "split").groupBy("model", "split").agg(F.avg("hit").alias("m"), A.mean_stderr(F.col("hit")).alias("se"), F.count("*").alias("n"))
    pool = one.groupBy("model").agg(A.pooled(F.collect_list(F.struct(F.col("split").alias("ord"), "m", "se", "n"))).alias("p"))  # a row a split
    return pool.select("model", F.round("p.mean", 6).alias("mean"), F.round("p.stderr", 6).alias("stderr"), F.col("p.n").alias("n"))


@query(f"""WITH {S_SQL}, v AS (SELECT model task, 'center_acc' metric, CAST(hit AS DOUBLE) v FROM s UNION ALL SELECT model, 'center_dist', dist FROM s WHERE dist IS NOT NULL)
SELECT task, metric, 'none' AS "filter", round(CASE WHEN avg(v) BETWEEN 0 AND 1 THEN avg(v) * 100 ELSE avg(v) END, 4) shown, round(stddev_samp(v) / sqrt(count(v)), 4) stderr, count(v) n FROM v GROUP BY task, metric""")
def report_long(spark, d):
    """The result table: a row for each task and metric."""
    s = scored(spark, d).select(F.col("model").alias("task"), F.col("hit").cast("double").alias("center_acc"), F.col("dist").alias("center_dist"))
    return report.results(report.long(s, ["task"], ["center_acc", "center_dist"]))


@query(f"""WITH {S_SQL}, o AS (SELECT model, hit, row_number() OVER (PARTITION BY model ORDER BY response_id) - 1 i, count(*) OVER (PARTITION BY model) n FROM s) SELECT model, hit middle FROM o WHERE i = n // 2""")
def positional_median(spark, d):
    """The value in the middle of the order of arrival."""
    return A.middle_in_order(scored(spark, d), ["model"], "response_id", "hit")


@query(f"WITH {S_SQL} SELECT model, round(sum(hit * area) / sum(area), 6) weighted_mean, round(max(hit), 6) best FROM (SELECT model, hit, (box[3] - box[1]) * (box[4] - box[2]) area FROM s) GROUP BY model")
def area_weighted_mean(spark, d):
    """Accuracy weighted by the area of the element."""
    s = scored(spark, d).withColumn("area", G.area(F.col("box")))
    return s.groupBy("model").agg(F.round(A.weighted_mean(F.col("hit") * F.col("area"), F.col("area")), 6).alias("weighted_mean"), F.round(F.max("hit").cast("double"), 6).alias("best"))


@query("""WITH e AS (SELECT DISTINCT response_id, rec_id, response FROM eval_responses WHERE rec_id IS NOT NULL AND response IS NOT NULL),
c AS (SELECT rec_id, response, count(*) n, min(response_id) f FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY n DESC, f) rk FROM c)
SELECT rec_id, response, n FROM k WHERE rk = 1""")
def filter_majority_vote(spark, d):
    """The most frequent response to each record; the first of equally frequent ones."""
    e = table(spark, d, "eval_responses").select("response_id", "rec_id", "response").distinct().where("rec_id IS NOT NULL AND response IS NOT NULL")
    return filters.majority(e, ["rec_id"], "response_id").select("rec_id", "response", "n")


@query(r"""WITH e AS (SELECT DISTINCT response_id, rec_id, response FROM eval_responses WHERE rec_id IS NOT NULL AND response IS NOT NULL),
g AS (SELECT rec_id, list(response ORDER BY response_id) r FROM e GROUP BY rec_id)
SELECT rec_id, r[1] AS "first", array_to_string(r[1:2], '|') two, array_to_string(list_transform(r, lambda x: lower(x)), '|') low, array_to_string(list_transform(r, lambda x: upper(x)), '|') up,
array_to_string(list_transform(r, lambda x: CASE WHEN starts_with(x, ' ') THEN substr(x, 2) ELSE x END), '|') trimmed,
array_to_string(list_transform(r, lambda x: coalesce(trim(nullif(regexp_extract(x, '\d+\.\d+'), '')), '[invalid]')), '|') decimal,
array_to_string(list_transform(r, lambda x: CASE x WHEN '' THEN 'empty' WHEN '[a,b]' THEN 'letters' ELSE 'other' END), '|') mapped FROM g""")
def filter_pipelines(spark, d):
    """Named filter pipelines over the responses of each record."""
    e = table(spark, d, "eval_responses").select("response_id", "rec_id", "response").distinct().where("rec_id IS NOT NULL AND response IS NOT NULL")
    kinds = {
        "first": [("take_first", {})], "two": [("take_first_k", {"k": 2})], "low": [("lowercase", {})], "up": [("uppercase", {})], "trimmed": [("remove_whitespace", {})],
        "decimal": [("regex", {"pattern": r"\d+\.\d+"})], "mapped": [("map", {"mapping": {"": "empty", "[a,b]": "letters"}, "default": "other"})],
    }
    g = filters.filtered(filters.grouped_responses(e, ["rec_id"], ["response_id"]), "resps", kinds)
    return g.select("rec_id", "first", *(F.array_join(c, "|").alias(c) for c in kinds if c != "first"))


@query("""WITH r AS (SELECT DISTINCT rec_id FROM func_records WHERE split = 'test'), o AS (SELECT rec_id, row_number() OVER (ORDER BY rec_id) - 1 doc_id, count(*) OVER () n FROM r)
SELECT rec_id, doc_id, doc_id % 4 AS "rank" FROM o WHERE doc_id < floor(n * 0.25) AND doc_id % 4 = 1""")
def strided_shard(spark, d):
    """The second of four strided shards of the first quarter of the test records."""
    from loomscope.operators import requests

    r = requests.numbered(table(spark, d, "func_records").where("split = 'test'").select("rec_id").distinct(), "rec_id")
    return requests.shard(requests.limited(r, 0.25), 1, 4).select("rec_id", "doc_id", F.lit(1).cast("bigint").alias("rank"))


@query("""WITH q AS (SELECT DISTINCT prompt, response, sha256('["generate_until","' || coalesce(prompt, '') || '"]') h, model FROM eval_responses),
c AS (SELECT DISTINCT h FROM q WHERE model = 'grounder_a') SELECT h request_hash, count(*) n FROM q WHERE h NOT IN (SELECT h FROM c) OR model = 'baseline' GROUP BY h""")
def response_cache(spark, d):
    """Requests that a cache of one model's requests can't answer, by request hash."""
    from loomscope.operators import requests

    q = table(spark, d, "eval_responses").select("prompt", "response", "model").distinct()
    q = q.withColumn("request_hash", requests.request_hash("generate_until", F.coalesce("prompt", F.lit(""))))
    cache = q.where("model = 'grounder_a'").select("request_hash").distinct()
    missed = requests.misses(q, cache, "request_hash").unionByName(q.where("model = 'baseline'").join(cache, "request_hash", "left_semi"))
    return missed.groupBy("request_hash").agg(F.count("*").alias("n"))


@query()
def bootstrap_stderr(spark, d):
    """Standard error of the median distance over resamples (its draws have no SQL form)."""
    s = scored(spark, d).where("dist IS NOT NULL").select(F.round("dist", 9).alias("dist"))
    return A.bootstrap_median_stderr(s, "dist", iterations=200)


@query(f"""WITH {S_SQL}, l AS (SELECT response_id, min(logged_at) logged_at FROM eval_responses GROUP BY 1)
SELECT epoch(time_bucket(INTERVAL '1 hour', logged_at)) "start", model, round(avg(hit), 6) mean, count(*) n FROM s JOIN l USING (response_id) GROUP BY ALL""")
def windowed_scores(spark, d):
    """Hits by hour and model, as the streaming score computes them."""
    from loomscope.streaming.scores import windowed_scores as windowed

    logged = table(spark, d, "eval_responses").groupBy("response_id").agg(F.min("logged_at").alias("logged_at"))
    out = windowed(scored(spark, d).join(logged, "response_id"), ["model"], "hit", "logged_at", "1 hour")
    return out.select(F.unix_timestamp("start").cast("double").alias("start"), "model", F.round("mean", 6).alias("mean"), "n")


GROUP_MEMBERS = [("grounders", "grounder_a"), ("grounders", "grounder_b"), ("everyone", "grounder_a"), ("everyone", "grounder_b"), ("everyone", "baseline")]


@query(f"""WITH {S_SQL}, t AS (SELECT model task, round(avg(hit) * 100, 4) shown, count(*) n FROM s GROUP BY model), g AS (SELECT * FROM (VALUES {", ".join(f"('{g}', '{t}')" for g, t in GROUP_MEMBERS)}) v(grp, task))
SELECT grp, 'center_acc' metric, round(sum(shown * n) / sum(n), 4) shown, CAST(sum(n) AS BIGINT) n FROM t JOIN g USING (task) GROUP BY grp""")
def group_results(spark, d):
    """Size-weighted means of groups of tasks; a task may be in several groups."""
    s = scored(spark, d).select(F.col("model").alias("task"), F.col("hit").cast("double").alias("center_acc"))
    groups = spark.createDataFrame(GROUP_MEMBERS, "group STRING, task STRING")
    out = report.grouped(report.results(report.long(s, ["task"], ["center_acc"])), groups)
    return out.select(F.col("group").alias("grp"), "metric", F.round("shown", 4).alias("shown"), "n")


CHOICES = ("Button", "Link", "Slider", "Text box")


@query(f"""WITH r AS (SELECT DISTINCT rec_id, func FROM func_records WHERE func IS NOT NULL), x AS (SELECT *, trim(regexp_replace(lower(func), '[\\p{{P}}]', '', 'g')) t FROM r),
p AS (SELECT rec_id, func, list_filter([{", ".join(f"{{'at': nullif(instr(t, '{c.lower()}'), 0), 'i': {i}}}" for i, c in enumerate(CHOICES))}], lambda o: o.at IS NOT NULL) o FROM x)
SELECT rec_id, CASE WHEN regexp_matches(func, '\\(([A-Z])\\)') THEN '(' || regexp_extract(func, '\\(([A-Z])\\)', 1) || ')' WHEN len(o) > 0 THEN '(' || chr(65 + CAST(list_min(o).i AS INT)) || ')'
WHEN regexp_matches(func, ':\\s*([A-Z])\\b') THEN '(' || regexp_extract(func, ':\\s*([A-Z])\\b', 1) || ')' ELSE '[invalid]' END choice FROM p""")
def filter_multi_choice(spark, d):
    """The option that a text names."""
    r = table(spark, d, "func_records").select("rec_id", "func").distinct().where("func IS NOT NULL")
    r = r.withColumns({"choices": F.array(*(F.lit(c) for c in CHOICES)), "resps": F.array("func")})
    return filters.filtered(r, "resps", {"choice": [("multi_choice_regex", {}), ("take_first", {})]}).select("rec_id", "choice")
