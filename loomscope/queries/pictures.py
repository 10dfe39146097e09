"""Picture sizes and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomscope.functions import geometry as G
from loomscope.operators import curate as C
from loomscope.queries.registry import query
from loomscope.session import table

GRIDS = [(336, 672), (672, 336), (672, 672), (1008, 336), (336, 1008)]
RATIOS = [(1, 1), (1, 2), (2, 1), (2, 2), (1, 3), (3, 1)]


def sized(spark, d):
    r = table(spark, d, "func_records").select("rec_id", "image_size", "unnormalized_box").distinct()
    w, h = G.size_of(F.col("image_size"))
    return r.withColumns({"w": w, "h": h}).where("w > 0 AND h > 0")


Z_SQL = """
z0 AS (SELECT DISTINCT rec_id, image_size, unnormalized_box b FROM func_records),
z AS (SELECT *, TRY_CAST(split_part(image_size, 'x', 1) AS DOUBLE) w, TRY_CAST(split_part(image_size, 'x', 2) AS DOUBLE) h FROM z0 WHERE TRY_CAST(split_part(image_size, 'x', 1) AS DOUBLE) > 0)"""


@query(f"WITH {Z_SQL} SELECT rec_id, [round(b[1] / w, 6), round(b[2] / h, 6), round(b[3] / w, 6), round(b[4] / h, 6)]::VARCHAR box, CAST((b[1] + b[3]) / 2 / w * 100 AS DOUBLE) IS NOT NULL known, round((b[3] - b[1]) * (b[4] - b[2]), 4) area FROM z WHERE b IS NOT NULL".replace("[round(b[1] / w, 6), round(b[2] / h, 6), round(b[3] / w, 6), round(b[4] / h, 6)]::VARCHAR box", "round(b[1] / w, 6) x1, round(b[4] / h, 6) y2"))
def normalised_boxes(spark, d):
    """Boxes in parts of the picture, and their area in pixels."""
    z, b = sized(spark, d).where("unnormalized_box IS NOT NULL"), F.col("unnormalized_box")
    n = G.normalised(b, F.col("image_size"))
    return z.select("rec_id", F.round(G.at(n, 0), 6).alias("x1"), F.round(G.at(n, 3), 6).alias("y2"), F.lit(True).alias("known"), F.round(G.area(b), 4).alias("area"))


@query(f"""WITH {Z_SQL} SELECT rec_id, '(' || CAST(trunc((b[1] / w + b[3] / w) / 2 * 100) AS INT) || ',' || CAST(trunc((b[2] / h + b[4] / h) / 2 * 100) AS INT) || ')' point,
'(' || CAST(trunc(b[1] / w * 1000) AS INT) || ',' || CAST(trunc(b[2] / h * 1000) AS INT) || ',' || CAST(trunc(b[3] / w * 1000) AS INT) || ',' || CAST(trunc(b[4] / h * 1000) AS INT) || ')' box FROM z WHERE b IS NOT NULL""")
def coordinate_texts(spark, d):
    """Points and boxes as the texts that a model is trained to give."""
    z = sized(spark, d).where("unnormalized_box IS NOT NULL")
    n = G.normalised(F.col("unnormalized_box"), F.col("image_size"))
    return z.select("rec_id", G.point_text(n, 100).alias("point"), G.box_text(n, 1000).alias("box"))


@query(f"WITH {Z_SQL}, s AS (SELECT DISTINCT image_size, CAST(w AS INT) w, CAST(h AS INT) h FROM z), c AS (SELECT image_size, w, unnest(range(0, greatest(0, h - 336) + 1, 168)) y FROM s WHERE h IS NOT NULL) SELECT image_size, unnest(range(0, greatest(0, w - 336) + 1, 168)) x, y FROM c")
def tile_grid(spark, d):
    """Corners of the sliding windows of each picture size."""
    s = sized(spark, d).select("image_size", F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h")).distinct()
    t = s.select("image_size", F.explode(G.tiles(F.col("w"), F.col("h"), 336, 168)).alias("t"))
    return t.select("image_size", F.col("t.x").cast("bigint").alias("x"), F.col("t.y").cast("bigint").alias("y"))


G_SQL = ", ".join(f"{{'o': {i}, 'w': {w}, 'h': {h}}}" for i, (w, h) in enumerate(GRIDS))


@query(f"""WITH {Z_SQL}, s AS (SELECT DISTINCT image_size, w, h FROM z), k AS (SELECT image_size, w, h, unnest([{G_SQL}]) g FROM s), e AS (SELECT image_size, g, least(floor(w * least(g.w / w, g.h / h)) * floor(h * least(g.w / w, g.h / h)), w * h) kept FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY image_size ORDER BY kept DESC, g.w * g.h - kept, g.o) r FROM e) SELECT image_size, CAST(g.w AS BIGINT) grid_w, CAST(g.h AS BIGINT) grid_h FROM o WHERE r = 1""")
def best_grid(spark, d):
    """The grid that keeps most pixels of each picture size."""
    s = sized(spark, d).select("image_size", "w", "h").distinct()
    best = G.best_grid(F.col("w"), F.col("h"), GRIDS)
    return s.select("image_size", best["w"].cast("bigint").alias("grid_w"), best["h"].cast("bigint").alias("grid_h"))


R_SQL = ", ".join(f"{{'o': {i}, 'w': {w}, 'h': {h}}}" for i, (w, h) in enumerate(RATIOS))


@query(f"""WITH {Z_SQL}, s AS (SELECT DISTINCT image_size, w, h FROM z), k AS (SELECT image_size, w, h, unnest([{R_SQL}]) g FROM s), e AS (SELECT image_size, g, abs(w / h - g.w / g.h) off, CASE WHEN g.o > 0 AND w * h > 0.5 * 448 * 448 * g.w * g.h THEN -g.o ELSE g.o END prefer FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY image_size ORDER BY off, prefer) r FROM e)
SELECT s.image_size, CAST(g.w AS BIGINT) ratio_w, CAST(g.h AS BIGINT) ratio_h,
CAST(CASE WHEN s.w >= s.h THEN 448 ELSE least(ceil(s.w * 448 / s.h), 448) END AS BIGINT) box_w, CAST(CASE WHEN s.w >= s.h THEN least(ceil(s.h * 448 / s.w), 448) ELSE 448 END AS BIGINT) box_h,
CAST(trunc(s.w * least(1.0, 640.0 / greatest(s.w, s.h))) AS BIGINT) small_w, CAST(trunc(s.h * least(1.0, 640.0 / greatest(s.w, s.h))) AS BIGINT) small_h,
CAST(greatest(1, least(floor(sqrt(256.0 * 16 / s.h * 16 / s.w) * s.h / 16), 256)) AS BIGINT) patch_rows FROM o JOIN s USING (image_size) WHERE r = 1""")
def picture_fits(spark, d):
    """Closest ratio, letterbox, shrunk size and patch rows of each picture size."""
    s, w, h = sized(spark, d).select("image_size", "w", "h").distinct(), F.col("w"), F.col("h")
    ratio, box, small, fit = G.closest_ratio(w, h, RATIOS), G.letterboxed(w, h, 448), G.shrunk(w, h, 640), G.patches(w, h, 16, 256)
    kinds = {"ratio_w": ratio["w"], "ratio_h": ratio["h"], "box_w": box["w"], "box_h": box["h"], "small_w": small["w"], "small_h": small["h"], "patch_rows": fit["rows"]}
    return s.select("image_size", *(v.cast("bigint").alias(k) for k, v in kinds.items()))


@query("""WITH t AS (SELECT trace_id, count(DISTINCT step_id) n FROM episode_steps GROUP BY trace_id) SELECT trace_id, unnest(range(0, 5)) k, CAST(floor(unnest(range(0, 5)) * (n - 1) / 4) AS BIGINT) pos FROM t""")
def spaced_frames(spark, d):
    """Five evenly spaced steps of each episode."""
    t = table(spark, d, "episode_steps").groupBy("trace_id").agg(F.countDistinct("step_id").alias("n"))
    p = t.select("trace_id", F.posexplode(C.spaced(F.col("n"), 5)).alias("k", "pos"))
    return p.select("trace_id", F.col("k").cast("bigint").alias("k"), F.col("pos").cast("bigint").alias("pos"))
