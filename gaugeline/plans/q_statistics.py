"""Queries on statistics per image and camera, and on data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import quality as Q
from gaugeline.operators import statistics as T
from gaugeline.plans import views
from gaugeline.plans.q_boxes import BOX, over, pitch_text
from gaugeline.plans.registry import mid, query, r6, sorted_list
from gaugeline.plans.views import NEEDS, VIEWS, sql

VIEWS["v_heights"] = "SELECT side AS camera, img, box_id, h, yc / 1536.0::DOUBLE AS y_norm FROM v_boxes"
NEEDS["v_heights"] = ["v_boxes"]


def heights(spark, sf):
    return views.boxes(spark, sf).select(
        F.col("side").alias("camera"), "img", "box_id", "h", (F.col("yc") / F.lit(float(views.HEIGHT))).alias("y_norm")
    )


@query("c1_positive_median", sql("v_boxes", f"""
SELECT img, round({mid('s')}, 6) AS median, round(list_sort(every)[len(every) // 2 + 1], 6) AS upper
FROM (SELECT img, {sorted_list('h', 'h > 1e-6')} AS s, list(h) AS every FROM v_boxes GROUP BY 1)"""))
def positive_median(spark, sf):
    return T.image_medians(views.boxes(spark, sf), "h").select("img", r6("median").alias("median"), r6("upper").alias("upper"))


@query("c2_mean_variance", sql("v_boxes", "SELECT img, round(avg(h), 6) AS mean, round(var_pop(h), 6) AS variance FROM v_boxes GROUP BY 1"))
def mean_variance(spark, sf):
    return T.mean_variance(views.boxes(spark, sf), ["img"], "h").select("img", r6("mean").alias("mean"), r6("variance").alias("variance"))


@query("c3_spacing_stats", sql("v_gaps", f"""
WITH g AS (SELECT side AS camera, img, gap FROM v_gaps WHERE gap > 0),
r AS (SELECT *, {mid('s')} AS raw FROM (SELECT camera, count(*) AS raw_spacing_count, count(DISTINCT img) AS sample_image_count,
             {sorted_list('gap', 'gap > 1e-6')} AS s FROM g GROUP BY 1)),
c AS (SELECT g.camera, gap, raw_spacing_count, sample_image_count FROM g JOIN (SELECT * EXCLUDE (s) FROM r) USING (camera) WHERE gap BETWEEN 0.35 * raw AND 2.5 * raw),
m AS (SELECT * EXCLUDE (s), {mid('s')} AS median_gap FROM (
      SELECT camera, any_value(raw_spacing_count) AS raw_spacing_count, any_value(sample_image_count) AS sample_image_count, count(*) AS spacing_count,
             avg(gap) AS mean_gap, var_pop(gap) AS variance_gap, {sorted_list('gap', 'gap > 1e-6')} AS s FROM c GROUP BY 1)),
d AS (SELECT camera, {sorted_list('abs(gap - median_gap)', 'abs(gap - median_gap) > 1e-6')} AS ds FROM c JOIN m USING (camera) GROUP BY 1),
x AS (SELECT m.*, coalesce({mid('ds')}, 0.0) AS mad, sqrt(variance_gap) AS sd FROM m JOIN d USING (camera))
SELECT camera, CAST(raw_spacing_count AS BIGINT) AS raw_spacing_count, CAST(sample_image_count AS BIGINT) AS sample_image_count, spacing_count,
       round(mean_gap, 6) AS mean_gap_px, round(median_gap, 6) AS median_gap_px, round(variance_gap, 4) AS variance_gap_px, round(mad, 6) AS mad_gap_px,
       round(sd, 6) AS std_gap_px, round(least(3.0 * median_gap, greatest(1.65 * median_gap, median_gap + 4.0 * 1.4826 * mad, mean_gap + 2.0 * sd)), 6) AS allowed_gap_px
FROM x WHERE raw_spacing_count >= 10"""))
def spacing_stats(spark, sf):
    labels = views.boxes(spark, sf).select(F.col("side").alias("camera"), "img", F.col("yc").alias("y"))
    stats = T.spacing_stats(labels)
    numbers = ("mean_gap_px", "median_gap_px", "mad_gap_px", "std_gap_px", "allowed_gap_px")
    return stats.select(
        "camera", "raw_spacing_count", "sample_image_count", "spacing_count", *[r6(c).alias(c) for c in numbers],
        F.round("variance_gap_px", 4).alias("variance_gap_px"),
    )


@query("c6_height_fit", sql("v_heights", """
SELECT camera, count(*) AS n, round(regr_slope(h, y_norm), 6) AS slope, round(regr_intercept(h, y_norm), 6) AS intercept, round(corr(y_norm, h), 6) AS pearson
FROM v_heights GROUP BY 1"""))
def height_fit(spark, sf):
    return T.height_fit(heights(spark, sf)).select("camera", "n", *[r6(c).alias(c) for c in ("slope", "intercept", "pearson")])


@query("c7_height_bins", sql("v_heights", f"""
WITH b AS (SELECT camera, CAST(least(floor(y_norm * 12), 11) AS INTEGER) + 1 AS bin, h FROM v_heights WHERE y_norm BETWEEN 0 AND 1),
s AS (SELECT camera, bin, count(*) AS n, avg(h) AS mean_h, min(h) AS min_h, max(h) AS max_h, {sorted_list('h')} AS l FROM b GROUP BY 1, 2)
SELECT c.camera, k.bin, coalesce(n, 0) AS n, round(mean_h, 6) AS mean_h, round(min_h, 6) AS min_h, round(max_h, 6) AS max_h, round({mid('l')}, 6) AS median_h
FROM (SELECT DISTINCT camera FROM v_heights) c CROSS JOIN (SELECT unnest(range(1, 13))::INTEGER AS bin) k LEFT JOIN s ON s.camera = c.camera AND s.bin = k.bin"""))
def height_bins(spark, sf):
    numbers = ("mean_h", "min_h", "max_h", "median_h")
    return T.height_bins(heights(spark, sf), 12).select("camera", "bin", "n", *[r6(c).alias(c) for c in numbers])


OUTLIERS = f"""
WITH f AS (SELECT camera, regr_slope(h, y_norm) AS b, regr_intercept(h, y_norm) AS a FROM v_heights GROUP BY 1),
r AS (SELECT v.*, a + b * y_norm AS expected, h - (a + b * y_norm) AS residual FROM v_heights v JOIN f USING (camera)),
m AS (SELECT camera, {mid('s')} AS med FROM (SELECT camera, {sorted_list('abs(residual)')} AS s FROM r GROUP BY 1)),
d AS (SELECT camera, {mid('ds')} AS mad FROM (SELECT camera, {sorted_list('abs(abs(residual) - med)')} AS ds FROM r JOIN m USING (camera) GROUP BY 1)),
z AS (SELECT r.*, abs(residual) / greatest(1e-6, 1.4826 * mad) AS z FROM r JOIN d USING (camera))"""


@query("c8_robust_outliers", sql("v_heights", OUTLIERS + """
SELECT camera, box_id, img, round(expected, 5) AS expected, round(residual, 5) AS residual, round(h / expected, 5) AS ratio, round(z, 5) AS z FROM z WHERE z >= 1.8"""))
def robust_outliers(spark, sf):
    rows = T.height_outliers(heights(spark, sf), 1.8)
    return rows.select("camera", "box_id", "img", *[F.round(c, 5).alias(c) for c in ("expected", "residual", "ratio", "z")])


@query("f1_top_outliers", sql("v_heights", OUTLIERS + """
SELECT camera, box_id, round(z, 5) AS z FROM z WHERE z >= 1.5 ORDER BY round(z, 9) DESC, box_id LIMIT 30"""))
def top_outliers(spark, sf):
    rows = T.height_outliers(heights(spark, sf), 1.5)
    return rows.orderBy(F.round("z", 9).desc(), "box_id").limit(30).select("camera", "box_id", F.round("z", 5).alias("z"))


@query("c10_side_scale", sql("v_items", f"""
SELECT run_id, side, round({mid('x')}, 6) AS ref_x, round(coalesce(meta, {mid('s')}), 6) AS px_per_in FROM (
  SELECT run_id, side, {sorted_list('ref_x', 'true')} AS x, {sorted_list('abs(offset_px) / distance_in', 'distance_in <> 0')} AS s,
         CASE WHEN run_id::BIGINT % 4 = 0 THEN 4.75::DOUBLE END AS meta FROM v_items GROUP BY 1, 2)"""))
def side_scale(spark, sf):
    items = views.items(spark, sf).withColumn("px_per_in", F.when(views.run_number() % 4 == 0, 4.75))
    return T.side_scale(items).select("run_id", "side", r6("ref_x").alias("ref_x"), r6("px_per_in").alias("px_per_in"))


def boundaries(spark, sf):
    """Point lists of each image: left and right edges of its boxes, from the top down."""
    edge = lambda c: F.transform(
        F.array_sort(F.collect_list(F.struct("yc", "box_id", c))), lambda b: F.struct(b[c].alias("x"), b["yc"].alias("y"))
    )
    return views.boxes(spark, sf).groupBy("run_id", "side", "img").agg(edge("x1").alias("left"), edge("x2").alias("right"))


VIEWS["v_boundaries"] = """
  SELECT run_id, side, img, list({'x': x1, 'y': yc} ORDER BY yc, box_id) AS "left", list({'x': x2, 'y': yc} ORDER BY yc, box_id) AS "right" FROM v_boxes GROUP BY 1, 2, 3"""
NEEDS["v_boundaries"] = ["v_boxes"]


@query("c11_polygon_y_bounds", sql("v_boxes", "SELECT img, round(min(yc), 6) AS top, round(max(yc), 6) AS bottom FROM v_boxes GROUP BY 1"))
def polygon_y_bounds(spark, sf):
    bounds = T.polygon_y_bounds(boundaries(spark, sf), ["left", "right"])
    return bounds.select("img", r6("top").alias("top"), r6("bottom").alias("bottom"))


@query("c16_boundary_roughness", sql("v_boxes", """
SELECT img, l AS left_roughness, r AS right_roughness, CASE WHEN l > r THEN 'left' ELSE 'right' END AS picked FROM (
  SELECT img, round(CASE WHEN count(*) < 3 THEN 0.0 ELSE stddev_pop(dl) END, 6) AS l, round(CASE WHEN count(*) < 3 THEN 0.0 ELSE stddev_pop(dr) END, 6) AS r
  FROM (SELECT img, x1 - lag(x1) OVER w AS dl, x2 - lag(x2) OVER w AS dr FROM v_boxes WINDOW w AS (PARTITION BY img ORDER BY yc, box_id)) GROUP BY 1)"""))
def boundary_roughness(spark, sf):
    rough = boundaries(spark, sf).select("img", r6(T.roughness("left")).alias("left_roughness"), r6(T.roughness("right")).alias("right_roughness"))
    return rough.withColumn("picked", F.when(F.col("left_roughness") > F.col("right_roughness"), "left").otherwise("right"))


@query("c12_span_prompt", sql("v_boxes", f"""
WITH g AS (SELECT *, yc - lag(yc) OVER w AS gap, count(*) OVER (PARTITION BY img) AS n, {mid('list_sort(list(h) OVER (PARTITION BY img))')} AS tall
           FROM v_boxes WINDOW w AS (PARTITION BY img ORDER BY yc, box_id)),
p AS (SELECT *, list_sort(list(gap) FILTER (WHERE gap > 1e-6 AND gap <= greatest(55.0, 4.0 * tall)) OVER (PARTITION BY img)) AS near,
                list_sort(list(gap) FILTER (WHERE gap > 1e-6) OVER (PARTITION BY img)) AS every FROM g),
c AS (SELECT *, sum(CASE WHEN gap > greatest(55.0, 2.8 * coalesce({mid('near')}, {mid('every')}, 1.4 * tall), 3.5 * tall) THEN 1 ELSE 0 END)
                OVER (PARTITION BY img ORDER BY yc, box_id) AS cluster FROM p),
s AS (SELECT *, count(*) OVER (PARTITION BY img, cluster) AS size FROM c),
b AS (SELECT *, max(size) OVER (PARTITION BY img) AS most FROM s),
m AS (SELECT *, min(cluster) FILTER (WHERE size = most) OVER (PARTITION BY img) AS lead_cluster FROM b),
k AS (SELECT * FROM m WHERE n < 3 OR size >= 3 OR (most < 3 AND cluster = lead_cluster)),
a AS (SELECT img, count(*) AS n, list_sort(list(h))[count(*) // 2 + 1] AS mh, list_sort(list(w))[count(*) // 2 + 1] AS mw, arg_min(y1, yc) AS top, arg_max(y2, yc) AS low,
             min(x1) AS lft, max(x2) AS rgt FROM k GROUP BY 1),
e AS (SELECT img, n, 0.0::DOUBLE AS x1, greatest(1.0, top - greatest(24.0, 2.0 * mh)) AS y1, least(1280.0, rgt + greatest(12.0, 0.75 * mw)) AS x2,
             least(1400.0, low + greatest(10.0, 0.6 * mh)) AS y2, greatest(0.0, lft - greatest(48.0, 6.0 * mw, 0.31 * 1280.0)) AS crop_x1 FROM a)
SELECT img, n, x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(crop_x1, 6) AS crop_x1 FROM e WHERE x2 > x1 + 2 AND y2 > y1 + 2"""))
def span_prompt(spark, sf):
    boxes = views.boxes(spark, sf)
    images = boxes.select("img").distinct().withColumns({"width": F.lit(1280), "height": F.lit(1400)})
    return T.span_prompt(boxes, images).select("img", "n", "x1", *[r6(c).alias(c) for c in ("y1", "x2", "y2", "crop_x1")])



@query("k1_capture_quality", sql("v_gaps", f"""
WITH q AS (SELECT img, CASE WHEN pitch BETWEEN 20 AND 60 THEN true ELSE false END AS pitch_ok FROM (
  {pitch_text(0.45, 1.75, f"CASE WHEN {mid('g')} IS NULL THEN 1.15 * {mid('hs')} ELSE greatest(coalesce({mid('c')}, {mid('g')}), 1.1 * {mid('hs')}) END")})),
a AS (SELECT run_id, img, count(*) AS n, count(*) FILTER (WHERE NOT (xc BETWEEN 590 AND 675 AND yc BETWEEN 15 AND 1480)) = 0 AS region_ok,
             count(*) FILTER (WHERE gap <= 0) = 0 AS order_ok, list({BOX}) AS b FROM v_gaps GROUP BY 1, 2),
o AS (SELECT *, len(list_filter(b, lambda p: len(list_filter(b, lambda s: s.box_id <> p.box_id AND {over('p.', 's.')} > 0.45)) > 0)) = 0 AS overlap_ok FROM a)
SELECT img, n, n BETWEEN 20 AND 45 AS count_ok, overlap_ok, order_ok, region_ok, pitch_ok,
       count(*) OVER (PARTITION BY run_id) = 2 AND max(n) OVER (PARTITION BY run_id) - min(n) OVER (PARTITION BY run_id) <= 1 AS pair_ok
FROM o JOIN q USING (img)"""))
def capture_quality(spark, sf):
    boxes = views.boxes(spark, sf)
    regions = boxes.select("img").distinct().withColumns({"x0": F.lit(590.0), "y0": F.lit(15.0), "x1": F.lit(675.0), "y1": F.lit(1480.0)})
    return Q.capture_quality(boxes, regions, 20, 45, 20.0, 60.0).drop("run_id", "side")


@query("k2_run_parity", sql("v_items", """
WITH a AS (SELECT run_id, tube_idx, distance_in, y_center FROM v_items WHERE side = '151' AND tube_idx % 13 <> 0),
b AS (SELECT run_id, tube_idx, distance_in + 0.25::DOUBLE * (tube_idx % 3) AS distance_in, y_center FROM v_items WHERE side = '151' AND tube_idx % 11 <> 0),
v AS (SELECT run_id, tube_idx, CASE WHEN a.run_id IS NULL THEN 'only_b' WHEN b.run_id IS NULL THEN 'only_a'
             WHEN abs(a.distance_in - b.distance_in) <= 0.3 AND abs(a.y_center - b.y_center) <= 0.3 THEN 'equal' ELSE 'differs' END AS verdict
      FROM a FULL JOIN b USING (run_id, tube_idx))
SELECT run_id, count(*) FILTER (WHERE verdict = 'equal') AS equal, count(*) FILTER (WHERE verdict = 'differs') AS differs,
       count(*) FILTER (WHERE verdict = 'only_a') AS only_a, count(*) FILTER (WHERE verdict = 'only_b') AS only_b FROM v GROUP BY 1"""))
def run_parity(spark, sf):
    items = views.items(spark, sf).filter(F.col("side") == "151")
    t = F.col("tube_idx")
    shifted = items.filter(t % 11 != 0).withColumn("distance_in", F.col("distance_in") + F.lit(0.25) * (t % 3))
    parity = Q.run_parity(items.filter(t % 13 != 0), shifted, ["run_id", "tube_idx"], ["distance_in", "y_center"], 0.3)
    return Q.parity_summary(parity)


VIEWS["v_model"] = "SELECT * FROM v_boxes WHERE conf >= 0.35"
NEEDS["v_model"] = ["v_boxes"]


@query("k3_detector_diff", sql("v_model", f"""
WITH v_gaps AS (SELECT *, lead(yc) OVER (PARTITION BY img ORDER BY yc, box_id) - yc AS gap FROM v_model),
pt AS ({pitch_text(0.45, 1.75, f"CASE WHEN {mid('g')} IS NULL THEN 1.15 * {mid('hs')} ELSE greatest(coalesce({mid('c')}, {mid('g')}), 1.1 * {mid('hs')}) END")}),
u AS (SELECT img, box_id, yc, 0 AS kind FROM v_model UNION ALL SELECT img, box_id, yc, 1 AS kind FROM v_boxes WHERE conf < 0.65),
n AS (SELECT *, row_number() OVER (PARTITION BY img, kind ORDER BY yc, box_id) AS nr FROM u),
c AS (SELECT *, CASE WHEN kind = 0 THEN {{'yc': yc, 'box_id': box_id, 'nr': nr}} END AS b FROM n),
w AS (SELECT *, last_value(b IGNORE NULLS) OVER (PARTITION BY img ORDER BY yc, kind, box_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above,
                first_value(b IGNORE NULLS) OVER (PARTITION BY img ORDER BY yc, kind, box_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below FROM c),
t AS (SELECT img, box_id, yc, nr, CASE WHEN below IS NULL OR yc - above.yc <= below.yc - yc THEN above ELSE below END AS nearest FROM w WHERE kind = 1),
h AS (SELECT t.img, t.box_id, t.nr, CASE WHEN abs(nearest.yc - yc) <= 0.5 * pt.pitch THEN nearest END AS hit FROM t LEFT JOIN pt ON pt.img = t.img)
SELECT img, box_id, hit.box_id AS model_box, CASE WHEN hit IS NULL THEN 'missing' WHEN count(*) OVER (PARTITION BY img, hit.box_id) > 1 THEN 'duplicate'
       WHEN hit.nr <> nr THEN 'misaligned' ELSE 'aligned' END AS verdict FROM h""").replace("round(CASE WHEN n >= 2", "(CASE WHEN n >= 2").replace("END END, 6) AS pitch", "END END) AS pitch"))
def detector_diff(spark, sf):
    boxes = views.boxes(spark, sf)
    return Q.detector_diff(boxes.filter(F.col("conf") >= 0.35), boxes.filter(F.col("conf") < 0.65)).drop("run_id", "side")
