"""Queries on runs, exports, histories and their files."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import catalogue as C
from gaugeline.operators import matching as P
from gaugeline.plans import views
from gaugeline.plans.q_scalars import ISO, iso_text
from gaugeline.plans.registry import query, r6
from gaugeline.plans.views import NEEDS, VIEWS, sql
from gaugeline.session import fresh_path
from gaugeline.sources import scans, sinks
from gaugeline.sources.annotation_files import write_files

STATUS = {"error": "capture_failed", "click": "processed", "view": "ready_for_annotation", "purchase": "processed_with_warning", "signup": "processing_failed"}
VIEWS["v_runs_log"] = f"""
  SELECT event_id, user_id, ts, 'r' || event_id AS run_id, {ISO} AS captured_at, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE event_type WHEN 'error' THEN 'capture_failed' WHEN 'click' THEN 'processed' WHEN 'view' THEN 'ready_for_annotation' WHEN 'purchase' THEN 'processed_with_warning' ELSE 'processing_failed' END AS status
  FROM events"""


def events(spark, sf):
    status = F.create_map(*[F.lit(v) for pair in STATUS.items() for v in pair])
    return views.table(spark, sf, "events").select(
        "event_id", "user_id", "ts", F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("run_id"), iso_text(None).alias("captured_at"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), status[F.col("event_type")].alias("status"),
    )


def manifests(spark, sf):
    """One manifest per event; failed captures carry no cameras and no counts."""
    e = F.col("event_id")
    camera = lambda side: F.struct(
        F.concat(F.lit(f"cam_{side}_"), F.col("run_id"), F.lit(".jpg")).alias("image_name"),
        F.concat(F.lit(f"raw/cam_{side}_"), F.col("run_id"), F.lit(".jpg")).alias("image_path"), F.col("captured_at").alias("captured_at"),
    )
    done = F.col("status") != "capture_failed"
    summary = F.struct(F.col("k").alias("matched"), F.when(e % 3 == 0, F.col("k") % 4).alias("left_only"), F.lit(None).cast("int").alias("right_only"))
    processing = F.struct(
        summary.alias("summary"), F.struct(F.col("k").alias("cam151"), (F.col("k") + 1).alias("cam152")).alias("tube_counts"),
        F.lit("yolo_pipe_end").alias("detection_source"), F.concat(F.lit("match/"), F.col("run_id"), F.lit(".json")).alias("match_path"),
    )
    return events(spark, sf).select(
        "run_id", "captured_at", "status", F.when(~done, "camera timeout").alias("error"),
        F.when(done, F.struct(camera("151").alias("cam151"), camera("152").alias("cam152"))).alias("cameras"), F.when(done, processing).alias("processing"),
    )


@query("a3_scan_manifests", sql("v_runs_log", """
SELECT run_id, captured_at, status, CASE WHEN status <> 'capture_failed' THEN k END AS matched, CASE WHEN status <> 'capture_failed' THEN 'cam_151_' || run_id || '.jpg' END AS image
FROM v_runs_log WHERE event_id % 50 <> 0"""))
def scan_manifests(spark, sf):
    path = fresh_path(spark, "manifests")
    broken = F.substring("run_id", 2, 20).cast("bigint") % 50 == 0
    text = F.to_json(F.struct("*"))
    manifests(spark, sf).select(F.when(broken, F.concat(F.lit('{"run_id": '), F.col("run_id"))).otherwise(text).alias("value")).write.text(path)
    rows = scans.scan_manifests(spark, path, whole_files=False)
    return rows.select("run_id", "captured_at", "status", F.col("processing.summary.matched").alias("matched"), F.col("cameras.cam151.image_name").alias("image"))


@query("a4_scan_datasets", sql("v_items", """
SELECT run_id, side, CAST(source_order AS BIGINT) AS position, tube_idx::BIGINT AS tube_idx, CASE WHEN tube_idx % 10 <> 0 THEN round(distance_in * 100) / 100 END AS distance_in, relative_position,
       CASE WHEN side = '151' THEN 47.75 ELSE 41.0 END::DOUBLE AS reference_in, CASE WHEN tube_idx % 3 = 0 THEN true ELSE active END AS active, unmatched, notes, CASE WHEN tube_idx % 10 = 0 THEN 'distance_missing' END AS error FROM v_items"""))
def scan_datasets(spark, sf):
    path = fresh_path(spark, "datasets")
    t = F.col("tube_idx")
    cents = F.concat_ws(".", F.floor(F.round(F.col("distance_in") * 100) / 100).cast("bigint").cast("string"), F.lpad((F.round(F.col("distance_in") * 100).cast("bigint") % 100).cast("string"), 2, "0"))
    item = F.struct(
        "source_order", t.cast("string").alias("tube_idx"), F.when(t % 10 == 0, "n/a").otherwise(cents).alias("distance_in"), F.round("offset_px").cast("bigint").cast("string").alias("offset_px"),
        "relative_position", F.when(t % 3 != 0, F.col("active")).alias("active"), "unmatched", "notes",
    )
    sets = views.items(spark, sf).groupBy("run_id", "side").agg(F.array_sort(F.collect_list(item)).alias("items"))
    sets.withColumn("side", F.concat(F.lit("CAM_"), "side")).write.json(path)
    rows = scans.scan_datasets(spark, path, whole_files=False)
    return rows.select("run_id", "side", "position", "tube_idx", "distance_in", "relative_position", "reference_in", "active", "unmatched", "notes", "error")


@query("a4_match_from_files", sql("v_rows", """
SELECT run_id, tube_number, match_status, tube_idx_151, tube_idx_152, round(measurement_151, 6) AS measurement_151, round(measurement_152, 6) AS measurement_152, r152_position, strategy FROM v_rows"""))
def match_from_files(spark, sf):
    """One JSON file of several lines per run and side, read back and matched."""
    path = fresh_path(spark, "set-files")
    n, every = views.run_number(), views.items(spark, sf)
    source = F.struct(
        F.col("y_center").alias("y_center_warp"), F.when(F.col("tube_idx") % 2 == 0, F.array(F.lit(0.0), F.lit(0.0), F.lit(9.0), F.col("box_height"))).alias("box_xywh"),
        F.when(F.col("tube_idx") % 2 == 1, F.array(F.lit(0.0), F.col("box_height"), F.lit(9.0), F.lit(0.0))).alias("box_xyxy"), F.lit("classic").alias("source"),
    )
    item = F.struct("source_order", "tube_idx", "distance_in", "offset_px", "relative_position", "active", "unmatched", "notes", source.alias("source_measurement"))
    sets = every.groupBy("run_id", "side").agg(F.array_sort(F.collect_list(item)).alias("items")).join(views.datasets(spark, sf), ["run_id", "side"])
    # bounds in one of four places; the model is told by the set's source or by its block
    pair, even = F.when(F.col("bounds_top").isNotNull(), F.array("bounds_bottom", "bounds_top")), n % 2 == 0
    named = F.when(F.col("bounds_top").isNotNull(), F.struct(F.col("bounds_top").alias("y_min"), F.col("bounds_bottom").alias("y_max")))
    block = F.struct(F.when(even & (n % 4 == 2), pair).alias("recovery_bounds_y"), F.struct(F.col("image_h").alias("height"), F.col("image_w").alias("width")).alias("image_size"))
    meta = F.struct(
        F.when(~even & (n % 4 == 1), pair).alias("bundle_bounds_y"), F.when(~even & (n % 4 == 3), F.struct(named.alias("sam_bundle_bounds_y"))).alias("sam_boundary"),
        F.when(even & (n % 4 == 0), named).alias("recovery_bounds_y"), F.when(even, block).alias("pipe_end_yolo"), F.when(even & (n % 4 == 0), "yolo_pipe_end").otherwise("classic").alias("detection_source"),
    )
    text = F.to_json(F.struct("run_id", "side", "items", meta.alias("extra_meta")), {"pretty": "true"})
    write_files(spark, sets.select(F.concat("side", F.lit("/"), "run_id", F.lit(".json")).alias("rel_path"), text.alias("value")), path)
    items = scans.scan_datasets_with_headers(spark, path).withColumn("source_order", F.col("position").cast("int")).withColumn("tube_idx", F.col("tube_idx").cast("int"))
    rows, _ = P.match_runs(items)
    return rows.select(
        "run_id", "tube_number", "match_status", "tube_idx_151", "tube_idx_152", r6("measurement_151").alias("measurement_151"), r6("measurement_152").alias("measurement_152"),
        "r152_position", "strategy",
    )


@query("a5_scan_match_results", sql("v_items", """
SELECT run_id, 1 AS version, tube_idx AS tube_number, CASE WHEN unmatched THEN 'left_only' ELSE 'matched' END AS match_status, round(distance_in, 6) AS total_length_in
FROM v_items WHERE side = '151' AND run_id::BIGINT % 6 <> 0"""))
def scan_match_results(spark, sf):
    path = fresh_path(spark, "results")
    row = F.struct(F.col("tube_idx").alias("tube_number"), F.when(F.col("unmatched"), "left_only").otherwise("matched").alias("match_status"), F.col("distance_in").alias("total_length_in"))
    results = views.items(spark, sf).filter(F.col("side") == "151").groupBy("run_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    results.withColumn("rows", F.when(views.run_number() % 6 != 0, F.col("rows"))).withColumn("version", F.when(views.run_number() % 2 == 0, 1)).write.json(path)
    rows = scans.scan_match_results(spark, path, whole_files=False)
    return rows.select("run_id", "version", "tube_number", "match_status", r6("total_length_in").alias("total_length_in"))


@query("a10_scan_boundaries", sql("v_boxes", """
SELECT CASE WHEN ascii(right(img, 1)) % 2 = 0 THEN 'sam_full_image' ELSE 'pipe_end_span' END AS source, 'cam' || side AS camera, 1280 AS width, 1536 AS height, round(min(yc), 6) AS top, round(max(yc), 6) AS bottom
FROM v_boxes GROUP BY img, side HAVING count(*) >= 2"""))
def scan_boundaries(spark, sf):
    path = fresh_path(spark, "boundaries")
    points = F.transform(F.array_sort(F.collect_list(F.struct("yc", "x1"))), lambda p: F.array(p["x1"], p["yc"]))
    polygons = views.boxes(spark, sf).groupBy("img", "side").agg(points.alias("boundary"))
    source = F.when(F.col("side") == "152", "sam_full_image").otherwise("pipe_end_span")
    text = F.to_json(F.struct(F.lit(1280).alias("width"), F.lit(1536).alias("height"), "boundary"), {"pretty": "true"})
    write_files(spark, polygons.select(F.concat(source, F.lit("/cam"), "side", F.lit("/"), "img", F.lit(".json")).alias("rel_path"), text.alias("value")), path)
    return scans.scan_boundaries(spark, path).select("source", "camera", "width", "height", r6("top").alias("top"), r6("bottom").alias("bottom"))


METRIC = "metrics/mAP50-95(B)"


def training_results(spark, sf):
    path = fresh_path(spark, "results-csv")
    metric = F.when(F.col("event_id") % 6 == 0, " ").otherwise(F.col("value").cast("string"))
    rows = views.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias(" epoch"), metric.alias(f" {METRIC}"))
    rows.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").csv(path)
    return scans.scan_training_results(spark, path)


@query("a11_scan_training_results", """
SELECT user_id::VARCHAR AS run, CAST(event_id AS INTEGER) AS epoch, CASE WHEN event_id % 6 <> 0 THEN value END AS metric FROM events""")
def scan_training_results(spark, sf):
    return training_results(spark, sf).select("run", F.col("epoch").try_cast("int").alias("epoch"), F.col(f"`{METRIC}`").try_cast("double").alias("metric"))


@query("f2_best_epoch", """
SELECT run, epoch, metric FROM (SELECT user_id::VARCHAR AS run, CAST(event_id AS INTEGER) AS epoch, CASE WHEN event_id % 6 <> 0 THEN value ELSE 0.0 END AS metric,
  row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 6 <> 0 THEN value ELSE 0.0 END DESC, event_id) AS k FROM events) WHERE k = 1""")
def best_epoch(spark, sf):
    rows = training_results(spark, sf)
    return C.best_epoch(rows.withColumnRenamed(METRIC, "m"), "m")


@query("a14_write_match_run", sql("v_order_rows", "SELECT run_id, tube_number, match_status, id_151, id_152 FROM v_order_rows"))
def write_match_run(spark, sf):
    """All runs are written, then the even ones again: they replace themselves."""
    path = fresh_path(spark, "match-runs")
    rows = P.order_match(P.active_order(P.by_run(views.items(spark, sf)))).select("run_id", "tube_number", "match_status", "id_151", "id_152")
    sinks.write_match_run(rows, path)
    sinks.write_match_run(rows.filter(views.run_number() % 2 == 0), path)
    return sinks.read_runs(spark, path, "tube_number int, match_status string, id_151 string, id_152 string, run_id string").select(*rows.columns)


@query("a17_export_measurements", sql("v_items", """
SELECT side, run_id, id, tube_idx, source_order, round(distance_in, 6) AS distance_in, relative_position, active, unmatched, notes FROM v_items"""))
def export_measurements(spark, sf):
    path = fresh_path(spark, "exports")
    items = views.items(spark, sf).withColumn("generated_at", F.lit("2024-01-01T00:00:00Z"))
    sinks.export_measurements(items, path)
    sinks.export_measurements(items.filter(views.run_number() % 3 == 0), path)
    item = "source_order:int,id:string,tube_idx:int,distance_in:double,relative_position:string,active:boolean,unmatched:boolean,notes:string"
    stored = sinks.read_runs(spark, path, f"generated_at string, items array<struct<{item}>>, side string, run_id string", "json")
    return stored.select("side", "run_id", F.inline("items")).withColumn("distance_in", r6("distance_in"))


@query("b30_run_state", sql("v_runs_log", """
SELECT run_id, captured_at, status, CASE WHEN status <> 'capture_failed' THEN k ELSE 0 END AS matched, CASE WHEN status <> 'capture_failed' AND event_id % 3 = 0 THEN k % 4 ELSE 0 END AS left_only, 0 AS right_only,
       CASE WHEN status <> 'capture_failed' THEN k ELSE 0 END AS tubes_cam151, CASE WHEN status <> 'capture_failed' THEN k + 1 ELSE 0 END AS tubes_cam152, substring(captured_at, 1, 10) AS captured_date,
       status = 'processed' AND ts = max(ts) FILTER (WHERE status = 'processed') OVER () AS is_latest FROM v_runs_log"""))
def run_state(spark, sf):
    newest = events(spark, sf).filter(F.col("status") == "processed").agg(F.max_by("run_id", "ts").alias("run_id"))
    return C.run_state(manifests(spark, sf), newest).select(
        "run_id", "captured_at", "status", "matched", "left_only", "right_only", "tubes_cam151", "tubes_cam152", "captured_date", "is_latest"
    )


@query("d26_latest_per_side", """
SELECT side, 'e' || event_id AS path, mtime FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY is_latest DESC, mtime DESC, 'e' || event_id DESC) AS r FROM (
  SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '151' ELSE '152' END AS side, event_id * 37 % 10007 AS mtime, event_type = 'click' AND user_id % 2 = 0 AS is_latest FROM events)) WHERE r = 1""")
def latest_per_side(spark, sf):
    even = F.col("user_id") % 2 == 0
    exports = views.table(spark, sf, "events").select(
        F.when(even, "151").otherwise("152").alias("side"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("path"),
        (F.col("event_id") * 37 % 10007).alias("mtime"), ((F.col("event_type") == "click") & even).alias("is_latest"),
    )
    return C.latest_per_side(exports)


@query("e11_dataset_as_of", """
WITH x AS (SELECT user_id, ts AS stamp, event_id * 37 % 10007 AS mtime, 'e' || event_id AS path FROM events WHERE event_type <> 'error' AND event_id % 7 <> 0),
m AS (SELECT event_id AS match_id, user_id, CASE WHEN event_id % 11 <> 0 THEN ts END AS ts, CASE WHEN event_id % 13 = 0 THEN 'given_' || event_id || '.json' WHEN event_id % 5 = 0 THEN 'latest.json' END AS input_path FROM events WHERE event_type = 'error'),
j AS (SELECT match_id, m.user_id, input_path, arg_max(path, {'m': mtime, 'p': path}) FILTER (WHERE stamp <= ts) AS a, arg_max(path, {'m': mtime, 'p': path}) AS n FROM m LEFT JOIN x USING (user_id) GROUP BY 1, 2, 3)
SELECT match_id, user_id, coalesce(CASE WHEN input_path <> 'latest.json' THEN input_path END, a, n, input_path) AS path,
       CASE WHEN input_path <> 'latest.json' THEN 'given' WHEN a IS NOT NULL THEN 'as_of' WHEN n IS NOT NULL THEN 'newest' WHEN input_path IS NOT NULL THEN 'input' ELSE 'none' END AS how FROM j""")
def dataset_as_of(spark, sf):
    rows = views.table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    e = F.col("event_id")
    exports = rows.filter(F.col("event_type") != "error").select(
        "user_id", F.when(e % 7 != 0, F.col("ts")).alias("stamp"), (e * 37 % 10007).alias("mtime"), F.concat(F.lit("e"), e.cast("string")).alias("path")
    )
    given = F.when(e % 13 == 0, F.concat(F.lit("given_"), e.cast("string"), F.lit(".json"))).when(e % 5 == 0, "latest.json")
    matches = rows.filter(F.col("event_type") == "error").select(e.alias("match_id"), "user_id", F.when(e % 11 != 0, F.col("ts")).alias("match_ts"), given.alias("input_path"))
    return C.dataset_as_of(matches, exports, "user_id")


@query("e17_pick_boundary", sql("v_boxes", """
WITH b AS (SELECT img, side, min(yc) AS top, max(yc) AS bottom, count(*) AS n FROM v_boxes GROUP BY 1, 2),
c AS (SELECT img, 'pipe_end_span' AS source, top, bottom - n % 3 AS bottom, 1280 + n % 4 AS w, 1 AS mtime FROM b UNION ALL SELECT img, 'sam_full_image', top, bottom - n % 2, 1280, 2 FROM b)
SELECT 'cam_' || side || '_' || b.img AS stem, source, round(c.top, 6) AS top, round(c.bottom, 6) AS bottom FROM b JOIN (
  SELECT *, row_number() OVER (PARTITION BY img ORDER BY bottom - top DESC, mtime DESC) AS k FROM c WHERE abs(w - 1280) <= 2) c ON c.img = b.img AND k = 1"""))
def pick_boundary(spark, sf):
    spans = views.boxes(spark, sf).groupBy("img", "side").agg(F.min("yc").alias("top"), F.max("yc").alias("bottom"), F.count(F.lit(1)).alias("n"))
    stem = lambda form: F.concat(F.lit(form), F.col("side"), F.lit("_"), F.col("img"))
    candidate = lambda source, less, width, mtime: spans.select(
        stem("cam").alias("stem"), F.lit(source).alias("source"), width.cast("int").alias("width"), F.lit(1536).alias("height"), "top", (F.col("bottom") - less).alias("bottom"), F.lit(mtime).alias("mtime")
    )
    found = candidate("pipe_end_span", F.col("n") % 3, 1280 + F.col("n") % 4, 1).unionByName(candidate("sam_full_image", F.col("n") % 2, F.lit(1280), 2))
    images = spans.select(stem("cam_").alias("stem"), F.lit(1280).alias("width"), F.lit(1536).alias("height"))
    return C.pick_boundary(images, found).select("stem", "source", r6("top").alias("top"), r6("bottom").alias("bottom"))


@query("e18_capture_history", sql("v_runs_log", """
SELECT run_id, captured_at, status, k AS matched FROM v_runs_log WHERE status LIKE 'processed%' AND (k % 3 = 0 OR k % 5 = 0)
UNION ALL SELECT 'artifact:old_' || event_id, captured_at, 'imported_artifact', k FROM v_runs_log WHERE status = 'capture_failed' AND k % 3 = 0"""))
def capture_history(spark, sf):
    rows = events(spark, sf)
    strategy = F.when(F.col("k") % 3 == 0, "sam_bundle_normalized_vertical_slots").otherwise("auto_vertical")
    counted = rows.select("run_id", "event_id", "captured_at", "status", F.col("k").alias("matched"), F.lit(0).alias("left_only"), F.lit(0).alias("right_only"), strategy.alias("strategy"), (F.col("k") % 5 == 0).alias("has_boundary"))
    states = counted.filter(F.col("status").startswith("processed"))
    legacy = counted.filter(F.col("status") == "capture_failed").withColumn("has_boundary", F.lit(False)).select(
        F.concat(F.lit("old_"), F.col("event_id").cast("string"), F.lit(".json")).alias("name"), F.col("captured_at").alias("generated_at"), "matched", "left_only", "right_only", "strategy", "has_boundary"
    )
    return C.capture_history(states, legacy).select("run_id", "captured_at", "status", "matched")


@query("e19_selection_history", sql("v_runs_log", """
WITH r AS (SELECT *, 'raw/' || event_id AS image_path, event_id % 4 <> 1 AS present FROM v_runs_log)
SELECT run_id AS selection_id, captured_at, image_path, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS source_rank FROM r WHERE present
UNION ALL SELECT 'artifact:' || run_id, captured_at, image_path, 2 FROM r WHERE present AND status = 'processed'"""))
def selection_history(spark, sf):
    e = F.col("event_id")
    rows = events(spark, sf).withColumn("image_path", F.concat(F.lit("raw/"), e.cast("string")))
    captures = rows.withColumn("selection_id", F.col("run_id"))
    artifacts = rows.filter(F.col("status") == "processed").withColumn("selection_id", F.concat(F.lit("artifact:"), "run_id"))
    images = rows.filter(e % 4 != 1).select("image_path")
    return C.selection_history([captures.filter(e % 2 == 0), captures], artifacts, images)


@query("e23_timeline", sql("v_runs_log", """
SELECT kind, side, run_id, hour_label FROM (
  SELECT 'capture' AS kind, CASE WHEN user_id % 2 = 0 THEN '151' ELSE '152' END AS side, run_id, CASE WHEN event_id % 4 = 3 THEN 'No time' ELSE strftime(ts, '%Y-%m-%d %H:00') END AS hour_label FROM v_runs_log WHERE event_id % 4 <> 1
  UNION ALL SELECT DISTINCT 'default', CASE WHEN user_id % 2 = 0 THEN '151' ELSE '152' END, 'default_20260422', 'Default baseline' FROM v_runs_log)"""))
def timeline(spark, sf):
    rows = events(spark, sf).withColumn("image_path", F.concat(F.lit("raw/"), "run_id")).withColumn("side", F.when(F.col("user_id") % 2 == 0, "151").otherwise("152"))
    images = rows.filter(F.col("event_id") % 4 != 1).select("image_path")
    baseline = rows.select("side").distinct().withColumns({"run_id": F.lit("default_20260422"), "captured_at": F.lit("2026-04-22T00:00:00-06:00")})
    return C.timeline(rows, images, baseline).select("kind", "side", "run_id", "hour_label")


@query("l1_retire_run", sql("v_runs_log", """
SELECT status, count(*) AS runs, count(*) FILTER (WHERE event_id % 10 = 0) AS pointers FROM v_runs_log WHERE NOT (k < 40 AND user_id % 3 > 0) GROUP BY 1"""))
def retire_run(spark, sf):
    rows = events(spark, sf)
    ids = rows.filter(F.col("k") < 40).select(
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("../"), "run_id")).otherwise(F.concat(F.lit(" "), F.col("run_id"))).alias("run_id")
    )
    pointers = rows.filter(F.col("event_id") % 10 == 0).select(F.concat(F.lit("t"), "run_id").alias("target"), "run_id")
    kept, left = C.retire_runs(rows, pointers, ids)
    marked = kept.join(left.select("run_id", F.lit(1).alias("p")), "run_id", "left")
    return marked.groupBy("status").agg(F.count(F.lit(1)).alias("runs"), F.count("p").alias("pointers"))


@query("l2_promote_latest", sql("v_runs_log", """
SELECT t.target, arg_max(run_id, {'ts': ts, 'r': run_id}) AS run_id FROM v_runs_log, (SELECT unnest(['cam151', 'cam152', 'match']) AS target) t WHERE status = 'processed' GROUP BY 1
UNION ALL SELECT 'first', min(run_id) FROM v_runs_log"""))
def promote_latest(spark, sf):
    rows = events(spark, sf)
    log = rows.agg(F.min("run_id").alias("run_id"), F.min("ts").alias("synced_at")).select(F.lit("first").alias("target"), "run_id", "synced_at")
    processed = rows.filter(F.col("status") == "processed").select("run_id", F.col("ts").alias("synced_at"))
    return C.latest_pointers(C.promote_latest(log, processed))
