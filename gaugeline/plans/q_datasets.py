"""Queries on annotation pools: labels, flags, samples, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import scalars as S
from gaugeline.operators import datasets as D
from gaugeline.operators import statistics as T
from gaugeline.plans import views
from gaugeline.plans.q_scalars import NEW_RECT, OLD_RECT, label_lines
from gaugeline.plans.q_statistics import OUTLIERS, boundaries, heights
from gaugeline.plans.registry import query, r6
from gaugeline.plans.views import NEEDS, VIEWS, sql
from gaugeline.session import fresh_path
from gaugeline.sources import scans, sinks
from gaugeline.sources.annotation_files import write_files

TASK = "pipe_end"
VIEWS["v_images"] = """
  SELECT doc_id, source AS camera, source || '/' || doc_id AS stem, source || '/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' ELSE '.jpeg' END AS rel_path FROM documents"""
VIEWS["v_pool_labels"] = """
  SELECT i.stem, CASE WHEN quality = 1 THEN 1 + doc_id % 5 ELSE 0 END AS box_count FROM labels JOIN v_images i USING (doc_id)"""
VIEWS["v_flags"] = """
  SELECT 'pipe_end' AS task, rel_path, stem, 'negative' AS flag FROM labels JOIN v_images USING (doc_id) WHERE quality = 0
  UNION ALL SELECT NULL, rel_path, stem, 'bad_warp' FROM labels JOIN v_images USING (doc_id) WHERE toxic = 1"""
VIEWS["v_samples"] = """
  SELECT i.camera, i.stem, box_count FROM v_images i JOIN v_pool_labels USING (stem)
  WHERE stem NOT IN (SELECT stem FROM v_flags WHERE flag = 'bad_warp') AND (box_count > 0 OR stem IN (SELECT stem FROM v_flags WHERE flag = 'negative'))"""
NEEDS.update({"v_pool_labels": ["v_images"], "v_flags": ["v_images"], "v_samples": ["v_pool_labels", "v_flags"]})


def images(spark, sf):
    doc = F.col("doc_id")
    suffix = F.when(doc % 3 == 0, ".jpg").when(doc % 3 == 1, ".png").otherwise(".jpeg")
    stem = F.concat(F.col("source"), F.lit("/"), doc.cast("string"))
    return views.table(spark, sf, "documents").select("doc_id", F.col("source").alias("camera"), stem.alias("stem"), F.concat(stem, suffix).alias("rel_path"))


def pool_labels(spark, sf):
    count = F.when(F.col("quality") == 1, 1 + F.col("doc_id") % 5).otherwise(0)
    return images(spark, sf).join(views.table(spark, sf, "labels"), "doc_id").select("stem", count.alias("box_count"))


def flags(spark, sf):
    """Flag rows by way of status lines and their reader shape."""
    rows = images(spark, sf).join(views.table(spark, sf, "labels"), "doc_id")
    pick = lambda test, task, name: rows.filter(test).select(
        F.lit(task).cast("string").alias("task"), "rel_path", F.lit(name).alias("flag"), F.lit(True).alias("value")
    )
    return pick(F.col("quality") == 0, TASK, "negative").unionByName(pick(F.col("toxic") == 1, None, "bad_warp"))


def samples(spark, sf):
    return D.training_samples(images(spark, sf), pool_labels(spark, sf), flags(spark, sf), TASK).select("camera", "stem", "box_count")


@query("a1_scan_labels", sql("v_lines", """
WITH f AS (SELECT side AS camera, img, string_split(value, ' ') AS f FROM v_lines)
SELECT camera, camera || '/' || img AS stem, f[2]::DOUBLE AS xn, f[3]::DOUBLE AS yn, f[4]::DOUBLE AS wn, f[5]::DOUBLE AS hn, f[6]::DOUBLE AS conf, round(greatest(0.0, f[2]::DOUBLE * 1280 - 0.5 * f[4]::DOUBLE * 1280), 6) AS x,
       round(greatest(0.0, f[5]::DOUBLE * 1536), 6) AS h FROM f WHERE len(f) IN (5, 6)"""))
def scan_labels(spark, sf):
    path = fresh_path(spark, "labels")
    texts = label_lines(spark, sf).groupBy("side", "img").agg(F.array_join(F.collect_list("value"), "\n").alias("value"))
    write_files(spark, texts.select(F.concat("side", F.lit("/"), "img", F.lit(".txt")).alias("rel_path"), "value"), path)
    parsed = scans.parse_labels(scans.scan_label_lines(spark, path))
    size = F.struct(F.lit(float(views.WIDTH)).alias("w"), F.lit(float(views.HEIGHT)).alias("h"))
    zero = lambda v: F.greatest(F.lit(0.0), v)
    return parsed.withColumn("s", size).select(
        "camera", "stem", "xn", "yn", "wn", "hn", "conf", r6(zero(F.col("xn") * F.col("s.w") - 0.5 * F.col("wn") * F.col("s.w"))).alias("x"), r6(zero(F.col("hn") * F.col("s.h"))).alias("h")
    )


@query("a2_validate_labels", sql("v_lines", """
WITH b AS (SELECT img, box_id, CASE l_linenumber WHEN 3 THEN '1' || substring(value, 2) WHEN 5 THEN replace(value, '0 0.', '0 1.') ELSE value END AS value FROM v_lines),
f AS (SELECT *, string_split(value, ' ') AS f FROM b)
SELECT img, box_id, CASE WHEN len(f) <> 5 THEN 'field_count' WHEN f[1] <> '0' THEN 'class'
       WHEN len(list_filter(f[2:5], lambda v: v::DOUBLE NOT BETWEEN 0 AND 1)) > 0 THEN 'range' WHEN f[4]::DOUBLE <= 0 OR f[5]::DOUBLE <= 0 THEN 'empty' END AS error FROM f"""))
def validate_labels(spark, sf):
    n = F.col("l_linenumber")
    broken = F.when(n == 3, F.concat(F.lit("1"), F.expr("substring(value, 2)"))).when(n == 5, F.replace("value", F.lit("0 0."), F.lit("0 1."))).otherwise(F.col("value"))
    return scans.validate_labels(label_lines(spark, sf).select("img", "box_id", broken.alias("value"))).select("img", "box_id", "error")


@query("a7_scan_image_flags", sql("v_flags", "SELECT task, rel_path, flag, true AS value FROM v_flags"))
def scan_image_flags(spark, sf):
    path = fresh_path(spark, "flags")
    back = F.regexp_replace("rel_path", "/", "\\\\")
    entry = F.create_map(back, F.col("value"))
    status = flags(spark, sf).select(
        F.when(F.col("flag") == "bad_warp", entry).alias("bad_warp"),
        F.when(F.col("flag") == "negative", F.create_map(F.col("task"), entry)).alias("negative_labels"),
    )
    status.write.json(path)
    return scans.scan_image_flags(spark, path, whole_files=False)


@query("a8_scan_images", sql("v_images", """
SELECT i.camera, i.rel_path, CASE i.doc_id % 3 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' ELSE 'jpeg' END AS suffix, CAST(coalesce(strlen(text), 0) AS BIGINT) AS length
FROM v_images i JOIN documents USING (doc_id)"""))
def scan_images(spark, sf):
    """One file per document, with another of a foreign suffix beside every fourth."""
    path = fresh_path(spark, "images")
    rows = images(spark, sf).join(views.table(spark, sf, "documents").select("doc_id", F.col("text").alias("value")), "doc_id")
    notes = rows.filter(F.col("doc_id") % 4 == 0).select(F.concat("rel_path", F.lit(".md")).alias("rel_path"), F.lit("note").alias("value"))
    write_files(spark, rows.select("rel_path", "value").unionByName(notes), path)
    return scans.scan_images(spark, path).select("camera", "rel_path", "suffix", "length")


@query("a9_parse_file_stamp", """
SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN '151' ELSE '152' END END AS side,
       CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS stamp, strftime(ts, '%Y%m%d_%H%M%S') AS run_id FROM events""")
def parse_file_stamp(spark, sf):
    e = F.col("event_id")
    side = F.when(e % 2 == 0, "151").otherwise("152")
    digits = F.date_format("ts", "yyyyMMdd_HHmmss")
    stamp_text = F.when(e % 11 == 0, F.lit("20241399_256199")).otherwise(digits)
    name = F.concat(F.when(e % 7 == 0, "view").otherwise("cam"), side, F.lit("_tube_measurements_"), stamp_text, F.lit(".json"))
    found, stamp = S.file_stamp(F.col("name"))
    return views.table(spark, sf, "events").select("event_id", name.alias("name"), F.concat(F.lit("cam_"), side, F.lit("_"), digits, F.lit(".jpg")).alias("image")).select(
        "event_id", found.alias("side"), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("stamp"), S.run_id_of(F.col("image")).alias("run_id")
    )


@query("a12_write_labels", sql("v_boxes", """
WITH c AS (SELECT img, yc, box_id, conf, greatest(0.0, least(650.0, x1)) AS a, greatest(0.0, least(1400.0, y1)) AS b, greatest(0.0, least(650.0, x2)) AS c, greatest(0.0, least(1400.0, y2)) AS d FROM v_boxes),
t AS (SELECT img, string_agg(printf('0 %.6f %.6f %.6f %.6f %.6f', round_even((a + 0.5 * (c - a)) / 650.0, 6), round_even((b + 0.5 * (d - b)) / 1400.0, 6), round_even((c - a) / 650.0, 6),
        round_even((d - b) / 1400.0, 6), round_even(conf, 6)) || chr(10), '' ORDER BY yc, box_id) AS text FROM c WHERE c > a AND d > b GROUP BY 1)
SELECT side AS camera, img, coalesce(text, '') AS text FROM (SELECT DISTINCT side, img FROM v_boxes) LEFT JOIN t USING (img)"""))
def write_labels(spark, sf):
    boxes = views.boxes(spark, sf)
    sizes = boxes.select("img", F.col("side").alias("camera")).distinct().withColumns({"width": F.lit(650), "height": F.lit(1400)})
    path = fresh_path(spark, "label-texts")
    sinks.write_labels(D.label_texts(boxes, sizes, with_conf=True).select("camera", "img", "text"), path)
    return spark.read.schema("camera string, img string, text string").parquet(path).select("camera", "img", "text")


@query("a13_write_polygon_labels", sql("v_boundaries v_boxes", """
WITH p AS (SELECT img, CASE WHEN ascii(right(img, 1)) % 2 = 0 THEN "left"[1:2] ELSE "left" END AS pts FROM v_boundaries),
e AS (SELECT img, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM v_boxes GROUP BY 1),
u AS (SELECT img, CASE WHEN len(pts) < 3 THEN [{'x': x1, 'y': y1}, {'x': x2, 'y': y1}, {'x': x2, 'y': y2}, {'x': x1, 'y': y2}] ELSE pts END AS pts FROM p JOIN e USING (img))
SELECT img, '0 ' || array_to_string(list_transform(pts, lambda q: printf('%.6f %.6f', round_even(q.x / 1283.0::DOUBLE, 6), round_even(q.y / 1531.0::DOUBLE, 6))), ' ') || chr(10) AS text FROM u"""))
def write_polygon_labels(spark, sf):
    edges = boundaries(spark, sf).withColumn("points", F.expr("CASE WHEN side = '152' THEN slice(left, 1, 2) ELSE left END"))
    boxes = views.boxes(spark, sf).groupBy("img").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    rows = edges.join(boxes, "img").withColumns({"width": F.lit(1283.0), "height": F.lit(1531.0)})
    return D.polygon_texts(rows).select("img", "text")


@query("a16_write_height_report", sql("v_heights", OUTLIERS + """,
o AS (SELECT camera, count(*) AS outliers FROM z WHERE z >= 1.8 GROUP BY 1),
b AS (SELECT camera, CAST(least(floor(y_norm * 12), 11) AS INTEGER) + 1 AS bin, count(*) AS n FROM v_heights WHERE y_norm BETWEEN 0 AND 1 GROUP BY 1, 2),
l AS (SELECT camera, array_to_string(list(bin || ':' || n ORDER BY bin), ' ') AS bins FROM b GROUP BY 1)
SELECT camera, count(*) AS boxes, count(DISTINCT img) AS images, round(sum(h), 4) AS height, round(regr_slope(h, y_norm), 6) AS slope, round(corr(y_norm, h), 6) AS pearson,
       any_value(coalesce(outliers, 0)) AS outliers, any_value(bins) AS bins FROM v_heights LEFT JOIN o USING (camera) JOIN l USING (camera) GROUP BY 1"""))
def write_height_report(spark, sf):
    """The boxes are read back from the CSV, the figures from the JSON."""
    path = fresh_path(spark, "height-report")
    rows = heights(spark, sf)
    sinks.write_height_report(rows, path, z=1.8)
    boxes = spark.read.option("header", "true").csv(f"{path}/boxes").groupBy(F.col("camera").cast("string").alias("camera")).agg(
        F.count(F.lit(1)).alias("boxes"), F.count_distinct("img").alias("images"), F.round(F.sum(F.col("h").cast("double")), 4).alias("height")
    )
    told = spark.read.schema("camera string, slope double, pearson double, outliers bigint, bins array<struct<bin:int,n:bigint>>").json(f"{path}/summary")
    filled = F.filter("bins", lambda b: b["n"] > 0)
    shown = F.array_join(F.transform(filled, lambda b: F.concat(b["bin"].cast("string"), F.lit(":"), b["n"].cast("string"))), " ")
    return boxes.join(told, "camera").select("camera", "boxes", "images", "height", r6("slope").alias("slope"), r6("pearson").alias("pearson"), "outliers", shown.alias("bins"))


@query("c4_image_tally", sql("v_pool_labels v_flags", """
SELECT rel_path, camera, coalesce(box_count, 0) AS box_count, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END AS prediction_count, coalesce(box_count, 0) > 0 OR neg AS labeled, neg AS negative, bad AS bad_warp, doc_id % 4 = 0 AS has_predictions
FROM (SELECT *, stem IN (SELECT stem FROM v_flags WHERE flag = 'negative') AS neg, stem IN (SELECT stem FROM v_flags WHERE flag = 'bad_warp') AS bad FROM v_images) LEFT JOIN v_pool_labels USING (stem)"""))
def image_tally(spark, sf):
    pool = images(spark, sf)
    predictions = pool.filter(F.col("doc_id") % 4 == 0).select("stem", F.lit(2).alias("prediction_count"))
    return D.image_tally(pool, pool_labels(spark, sf), predictions, flags(spark, sf), TASK).drop("doc_id", "stem")


@query("e1_label_image_join", sql("v_pool_labels", "SELECT rel_path, box_count, CASE WHEN box_count IS NULL THEN 'missing_label' END AS error FROM v_images LEFT JOIN v_pool_labels USING (stem)"))
def label_image_join(spark, sf):
    return D.label_image_join(images(spark, sf), pool_labels(spark, sf)).select("rel_path", "box_count", "error")


@query("e2_unlabeled_images", sql("v_pool_labels", "SELECT rel_path FROM v_images WHERE stem NOT IN (SELECT stem FROM v_pool_labels WHERE box_count > 0)"))
def unlabeled_images(spark, sf):
    return D.unlabeled_images(images(spark, sf), pool_labels(spark, sf)).select("rel_path")


@query("e3_drop_bad_images", sql("v_flags", "SELECT rel_path FROM v_images WHERE stem NOT IN (SELECT stem FROM v_flags WHERE flag = 'bad_warp')"))
def drop_bad_images(spark, sf):
    return D.drop_bad_images(images(spark, sf), flags(spark, sf), "stem").select("rel_path")


@query("h6_training_samples", sql("v_samples", "SELECT camera, stem, box_count FROM v_samples"))
def training_samples(spark, sf):
    return samples(spark, sf)


RANKED = "(SELECT *, row_number() OVER (ORDER BY md5('{0}:' || stem), stem) AS k, count(*) OVER () AS n FROM v_samples)"
THREE = f"(SELECT *, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.7::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM {RANKED.format(7)})"


@query("h1_split_three", sql("v_samples", f"SELECT stem, split FROM {THREE}"))
def split_three(spark, sf):
    return D.split_three(samples(spark, sf), 0.7, 0.2, 0.1, 7).select("stem", "split")


@query("c13_split_tally", sql("v_samples", f"""
SELECT split, count(*) AS images, count(*) FILTER (WHERE box_count > 0) AS positives, count(*) FILTER (WHERE box_count = 0) AS negatives, CAST(sum(box_count) AS BIGINT) AS instances
FROM {THREE} GROUP BY 1"""))
def split_tally(spark, sf):
    return D.split_tally(D.split_three(samples(spark, sf), 0.7, 0.2, 0.1, 7))


@query("h2_split_train_val", sql("v_samples", f"""
SELECT stem, unnest(CASE WHEN n < 8 THEN ['train', 'val'] WHEN k <= greatest(1, round_even(0.2 * n, 0)) THEN ['val'] ELSE ['train'] END) AS split FROM {RANKED.format(42)}"""))
def split_train_val(spark, sf):
    return D.split_train_val(samples(spark, sf)).select("stem", "split")


@query("h4_positive_split", sql("v_samples", """
SELECT stem, CASE WHEN k <= CASE WHEN n >= 8 THEN greatest(1, round_even(0.25 * n, 0)) ELSE n END THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY md5('5:' || stem), stem) AS k, count(*) OVER () AS n FROM v_samples WHERE box_count > 0)"""))
def positive_split(spark, sf):
    return D.positive_split(samples(spark, sf).filter(F.col("box_count") > 0), 0.25, 5).select("stem", "split")


@query("h3_limited_negatives", sql("v_pool_labels", """
WITH r AS (SELECT camera, stem, row_number() OVER (PARTITION BY camera ORDER BY md5('9:' || stem), stem) AS k FROM v_images WHERE stem NOT IN (SELECT stem FROM v_pool_labels WHERE box_count > 0)),
v AS (SELECT * FROM r ORDER BY k, camera LIMIT 17), t AS (SELECT camera, count(*) AS taken FROM v GROUP BY 1),
q AS (SELECT r.camera, stem FROM r LEFT JOIN t ON t.camera = r.camera WHERE k > coalesce(taken, 0) ORDER BY k - coalesce(taken, 0), r.camera LIMIT 45)
SELECT camera, stem, 'val' AS split FROM v UNION ALL SELECT camera, stem, 'train' AS split FROM q"""))
def limited_negatives(spark, sf):
    return D.limited_negatives(D.unlabeled_images(images(spark, sf), pool_labels(spark, sf)), 45, 17, 9)


@query("h5_training_gate", sql("v_samples", "SELECT count(*) AS images, count(*) FILTER (WHERE box_count > 0) AS with_boxes, count(*) >= 20 AS ready FROM v_samples"))
def training_gate(spark, sf):
    return D.training_gate(samples(spark, sf), 20)


@query("l3_set_flag", """
SELECT stem, flag FROM (SELECT user_id::VARCHAR AS stem, CASE WHEN event_id % 2 = 0 THEN 'negative' ELSE 'bad_warp' END AS flag, arg_max(event_type IN ('click', 'view'), {'ts': ts, 'e': event_id}) AS v
  FROM events GROUP BY 1, 2) WHERE v""")
def set_flag(spark, sf):
    e = F.col("event_id")
    events = views.table(spark, sf, "events").select(
        F.lit(TASK).alias("task"), F.concat(F.col("user_id").cast("string"), F.when(e % 3 == 0, ".png").otherwise(".jpg")).alias("rel_path"),
        F.when(e % 2 == 0, "negative").otherwise("bad_warp").alias("flag"), F.col("event_type").isin("click", "view").alias("value"), "ts", "event_id",
    )
    return D.set_flags(events).select("stem", "flag")


@query("l5_relabel_after_recrop", sql("v_lines", """
SELECT camera, count(*) AS images, count(n) AS relabelled, CAST(coalesce(sum(n), 0) AS BIGINT) AS lines FROM (SELECT DISTINCT side AS camera, img FROM v_lines WHERE run_id::BIGINT % 3 <> 0)
LEFT JOIN (SELECT img, count(*) AS n FROM v_lines WHERE l_linenumber > 1 GROUP BY 1) USING (img) GROUP BY 1"""))
def relabel_after_recrop(spark, sf):
    lines = label_lines(spark, sf).filter(F.col("l_linenumber") > 1).select(F.col("side").alias("camera"), F.col("img").alias("stem"), "value")
    pool = views.boxes(spark, sf).filter(views.run_number() % 3 != 0).select(F.col("side").alias("camera"), F.col("img").alias("stem")).distinct()
    return D.relabel_tally(lines, pool, D.relabel_after_recrop(lines, pool, OLD_RECT, NEW_RECT))
