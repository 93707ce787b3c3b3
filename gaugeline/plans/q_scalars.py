"""Queries on single rows: casts, names, geometry, configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import scalars as S
from gaugeline.operators import measure as M
from gaugeline.plans import views
from gaugeline.plans.registry import query, r6
from gaugeline.plans.views import sql

KEY = ["l_orderkey", "l_linenumber", "l_suppkey"]
KEYS = ", ".join(KEY)
ALIASES = [" LEFT ", "cam_151", "izq", "Right", "CAM152", "derecha", "top"]


def by_line_number(values):
    column = F.when(F.col("l_linenumber") == 1, values[0])
    for i, value in enumerate(values[1:], start=2):
        column = column.when(F.col("l_linenumber") == i, value)
    return column


@query("b1_norm_side", f"""
SELECT raw, CASE WHEN lower(trim(raw)) IN ('151', 'cam151', 'cam_151', 'left', 'izq', 'izquierda') THEN '151'
                 WHEN lower(trim(raw)) IN ('152', 'cam152', 'cam_152', 'right', 'der', 'derecha') THEN '152' END AS side, count(*) AS n
FROM (SELECT {ALIASES}[l_linenumber] AS raw FROM lineitem) GROUP BY ALL""")
def norm_side(spark, sf):
    raw = views.table(spark, sf, "lineitem").select(by_line_number(ALIASES).alias("raw"))
    return raw.groupBy("raw", S.norm_side(F.col("raw")).alias("side")).agg(F.count(F.lit(1)).alias("n"))


RAW_NUMBERS = """CASE l_linenumber WHEN 1 THEN CAST(l_quantity AS BIGINT)::VARCHAR || '.5' WHEN 2 THEN 'nan' WHEN 3 THEN '-inf'
  WHEN 4 THEN ' ' || l_orderkey || ' ' WHEN 5 THEN 'x' || l_orderkey WHEN 6 THEN CAST(l_quantity AS BIGINT)::VARCHAR || 'e2' END"""


@query("b2_lenient_numbers", rf"""
SELECT raw, number, CAST(round_even(number, 0) AS BIGINT) AS whole, count(*) AS n FROM (
  SELECT raw, CASE WHEN regexp_full_match(trim(raw), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
                   THEN try_cast(trim(raw) AS DOUBLE) END AS number
  FROM (SELECT {RAW_NUMBERS} AS raw FROM lineitem)) GROUP BY ALL""")
def lenient_numbers(spark, sf):
    q, key = F.col("l_quantity").cast("bigint").cast("string"), F.col("l_orderkey").cast("string")
    texts = [F.concat(q, F.lit(".5")), F.lit("nan"), F.lit("-inf"), F.concat(F.lit(" "), key, F.lit(" ")),
             F.concat(F.lit("x"), key), F.concat(q, F.lit("e2"))]
    raw = views.table(spark, sf, "lineitem").select(by_line_number(texts).alias("raw"))
    return raw.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select(
        "raw", S.lenient_double(F.col("raw")).alias("number"), S.lenient_int(F.col("raw")).alias("whole"), "n"
    )


@query("b3_safe_name", r"""
SELECT doc_id, md5(coalesce(nullif(trim(regexp_replace(trim(text), '[^\p{L}\p{N}_-]', '_', 'g'), '_'), ''), 'asset')) AS safe,
       coalesce(nullif(trim(regexp_replace(trim(' ' || source || ' / ' || lang || '#'), '[^a-zA-Z0-9_-]+', '_', 'g'), '_'), ''), 'asset') AS token
FROM documents""")
def safe_name(spark, sf):
    docs = views.table(spark, sf, "documents")
    label = F.concat(F.lit(" "), F.col("source"), F.lit(" / "), F.col("lang"), F.lit("#"))
    return docs.select(
        "doc_id", F.md5(S.safe_name(F.col("text"), "asset")).alias("safe"), S.token_name(label, "asset").alias("token")
    )


@query("b6_clip_boxes", sql("v_boxes", """
SELECT img, box_id, round(cx1, 6) AS x1, round(cy1, 6) AS y1, round(cx2, 6) AS x2, round(cy2, 6) AS y2
FROM (SELECT img, box_id, greatest(0.0, least(650.0, x1)) AS cx1, greatest(0.0, least(1300.0, y1)) AS cy1,
             greatest(0.0, least(650.0, x2)) AS cx2, greatest(0.0, least(1300.0, y2)) AS cy2 FROM v_boxes)
WHERE cx2 > cx1 AND cy2 > cy1"""))
def clip_boxes(spark, sf):
    boxes = views.boxes(spark, sf).select("img", "box_id", "x1", "y1", "x2", "y2")
    images = boxes.select("img").distinct().withColumns({"width": F.lit(650), "height": F.lit(1300)})
    return M.clip_boxes(boxes, images).select("img", "box_id", *[r6(c).alias(c) for c in ("x1", "y1", "x2", "y2")])


def label_lines(spark, sf):
    """Text label lines of the boxes; some lines are short, some carry a confidence."""
    six = [M.fixed6(F.col(c) / F.lit(float(d))) for c, d in
           (("xc", views.WIDTH), ("yc", views.HEIGHT), ("w", views.WIDTH), ("h", views.HEIGHT))]
    conf = F.when(F.col("l_linenumber") % 2 == 0, M.fixed6(F.col("conf")))
    return views.boxes(spark, sf).select(
        "run_id", "side", "img", "box_id", "l_linenumber",
        F.when(F.col("l_linenumber") == 7, "0 broken").otherwise(F.concat_ws(" ", F.lit("0"), *six, conf)).alias("value"),
    )


views.VIEWS["v_lines"] = """
  SELECT run_id, side, img, box_id, l_linenumber, CASE WHEN l_linenumber = 7 THEN '0 broken' ELSE
    printf('0 %.6f %.6f %.6f %.6f', round_even(xc / 1280.0::DOUBLE, 6), round_even(yc / 1536.0::DOUBLE, 6),
      round_even(w / 1280.0::DOUBLE, 6), round_even(h / 1536.0::DOUBLE, 6))
    || CASE WHEN l_linenumber % 2 = 0 THEN printf(' %.6f', round_even(conf, 6)) ELSE '' END END AS value FROM v_boxes"""
views.NEEDS["v_lines"] = ["v_boxes"]

OLD_RECT = (0.0, 0.0, 1280.0, 1536.0)
NEW_RECT = (-12.5, 20.25, 1100.0, 1500.0)


@query("b7_rebase_labels", sql("v_lines", """
WITH p AS (SELECT img, box_id, value, string_split(value, ' ') AS f FROM v_lines),
n AS (SELECT *, f[2]::DOUBLE AS a, try_cast(f[3] AS DOUBLE) AS b, try_cast(f[4] AS DOUBLE) AS c, try_cast(f[5] AS DOUBLE) AS d
      FROM p WHERE len(f) >= 5)
SELECT img, box_id, printf('%s %.6f %.6f %.6f %.6f', f[1],
         round_even(greatest(0.0, least(1.0, (a * 1280.0::DOUBLE + 12.5::DOUBLE) / 1112.5::DOUBLE)), 6),
         round_even(greatest(0.0, least(1.0, (b * 1536.0::DOUBLE - 20.25::DOUBLE) / 1479.75::DOUBLE)), 6),
         round_even(greatest(0.0, least(1.0, c * 1280.0::DOUBLE / 1112.5::DOUBLE)), 6), round_even(greatest(0.0, least(1.0, d * 1536.0::DOUBLE / 1479.75::DOUBLE)), 6))
       || CASE WHEN len(f) = 6 THEN ' ' || f[6] ELSE '' END AS line FROM n
UNION ALL SELECT img, box_id, value AS line FROM p WHERE len(f) < 5"""))
def rebase_labels(spark, sf):
    lines = label_lines(spark, sf)
    return lines.select("img", "box_id", M.rebase_line(F.col("value"), OLD_RECT, NEW_RECT).alias("line"))


@query("b8_normalize_items", sql("v_boxes", """
WITH r AS (SELECT run_id, side, row_number() OVER (PARTITION BY img ORDER BY yc, box_id) - 1 AS position, l_linenumber AS k, round(xc) AS x FROM v_boxes),
t AS (SELECT run_id, side, position, CASE WHEN k = 2 THEN 40 ELSE position + 1 END AS tube_idx,
             CASE WHEN k <> 5 THEN x - 600 END AS distance_in, CASE WHEN k <> 3 THEN x - 630 END AS offset_px,
             CASE WHEN k = 4 THEN 'after' WHEN k = 6 THEN 'beside' END AS given FROM r)
SELECT run_id, side, position, tube_idx, CAST(distance_in AS DOUBLE) AS distance_in, CAST(offset_px AS DOUBLE) AS offset_px,
       CASE WHEN offset_px < 0 THEN 'negative' WHEN offset_px > 0 THEN 'positive' WHEN offset_px = 0 THEN 'zero' END AS offset_direction,
       CASE WHEN side = '152' THEN CASE WHEN given = 'after' OR offset_px < 0 THEN 'after' ELSE 'before' END END AS relative_position,
       CASE WHEN distance_in IS NULL THEN 'distance_missing' END AS error,
       side || '-' || printf('%03d', tube_idx) || '-' || printf('%03d', position) AS id FROM t"""))
def normalize_items(spark, sf):
    from gaugeline.operators.boxes import top_down

    k, x = F.col("l_linenumber"), F.round("xc").cast("bigint")
    raw = views.boxes(spark, sf).select(
        "run_id", "side", (F.row_number().over(top_down()) - 1).cast("bigint").alias("position"),
        F.when(k == 2, " 40.4 ").alias("raw_tube_idx"),
        F.when(k == 5, "n/a").otherwise((x - 600).cast("string")).alias("raw_distance"),
        F.when(k == 3, "nan").otherwise((x - 630).cast("string")).alias("raw_offset"),
        F.when(k == 4, " After").when(k == 6, "beside").alias("raw_relative"),
    )
    return M.normalize_items(raw)


def reference_table(spark):
    """One reference line per side: two rows, keyed by side."""
    return spark.createDataFrame(
        [("151", "ref_02", 605.0, 0.0, 615.0, 1500.0, 5.0, 610.0), ("152", "ref_01", 612.0, 0.0, 608.0, 1500.0, 5.0, 610.0)],
        "side string, label string, lx0 double, ly0 double, lx1 double, ly1 double, px_per_in double, const_x double",
    )


views.VIEWS["v_ref"] = """
  SELECT * FROM (VALUES ('151', 605.0::DOUBLE, 615.0::DOUBLE), ('152', 612.0::DOUBLE, 608.0::DOUBLE)) t(side, lx0, lx1)"""
views.VIEWS["v_measured"] = """
  SELECT b.*, lx0 + (yc - 0.0::DOUBLE) / 1500.0::DOUBLE * (lx1 - lx0) AS ref_x,
         xc - (lx0 + (yc - 0.0::DOUBLE) / 1500.0::DOUBLE * (lx1 - lx0)) AS offset_px FROM v_boxes b JOIN v_ref USING (side)"""
views.NEEDS["v_measured"] = ["v_boxes", "v_ref"]


@query("b9_ref_x_at_y", sql("v_boxes v_ref", """
SELECT img, box_id, round(CASE WHEN l_linenumber = 1 THEN 610.0 ELSE lx0 + yc / 1500.0::DOUBLE * (lx1 - lx0) END, 6) AS ref_x
FROM v_boxes JOIN v_ref USING (side)"""))
def ref_x_at_y(spark, sf):
    points = views.boxes(spark, sf).select("img", "box_id", "side", F.when(F.col("l_linenumber") != 1, F.col("yc")).alias("y"))
    return M.ref_x_at_y(points, F.broadcast(reference_table(spark))).select("img", "box_id", r6("ref_x").alias("ref_x"))


@query("b10_measure_offsets", sql("v_measured", """
SELECT img, box_id, round(ref_x, 6) AS ref_x, round(offset_px, 6) AS offset_px, round(abs(offset_px) / 5.0::DOUBLE, 6) AS distance_in,
       CASE WHEN side = '152' THEN CASE WHEN offset_px < 0 THEN 'after' ELSE 'before' END END AS relative_position FROM v_measured"""))
def measure_offsets(spark, sf):
    # two rows by construction: one per side
    measured = M.measure_offsets(views.boxes(spark, sf), F.broadcast(reference_table(spark)))
    return measured.select("img", "box_id", *[r6(c).alias(c) for c in ("ref_x", "offset_px", "distance_in")], "relative_position")


@query("b11_residuals", sql("v_items", """
SELECT run_id, id, round(CASE WHEN side = '151' THEN distance_in - 47.75::DOUBLE WHEN relative_position = 'before' THEN 41.0::DOUBLE - distance_in
       ELSE 41.0::DOUBLE + distance_in END, 6) AS residual FROM v_items"""))
def residuals(spark, sf):
    return M.residual_columns(views.items(spark, sf)).select("run_id", "id", r6("residual").alias("residual"))


@query("b13_format_feet", """
WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN o_totalprice / 1000.0::DOUBLE END AS inches FROM orders),
a AS (SELECT *, floor(inches / 12.0) AS ft, greatest(0.0, inches - floor(inches / 12.0) * 12.0) AS rest FROM v),
b AS (SELECT *, CAST(floor(rest + 1e-9) AS BIGINT) AS w, CAST(round_even(greatest(0.0, rest - floor(rest + 1e-9)) * 8, 0) AS BIGINT) AS n FROM a),
c AS (SELECT o_orderkey, inches, CAST(ft + (w + n // 8) // 12 AS BIGINT) AS feet, CAST((w + n // 8) % 12 AS BIGINT) AS whole, n % 8 AS n FROM b)
SELECT o_orderkey, CASE WHEN inches IS NULL THEN '-' WHEN n = 0 THEN feet || ' - ' || whole
  ELSE feet || ' - ' || CASE WHEN whole > 0 THEN whole || ' & ' ELSE '' END || (n // gcd(n, 8)) || '/' || (8 // gcd(n, 8)) END AS shown FROM c""")
def format_feet(spark, sf):
    inches = F.when(F.col("o_orderkey") % 11 > 0, F.col("o_totalprice") / 1000.0)
    return views.table(spark, sf, "orders").select("o_orderkey", S.format_feet(inches).alias("shown"))


@query("b23_rects_and_points", sql("v_boxes", """
SELECT img, box_id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, px, py FROM (
  SELECT img, box_id, greatest(0.0, least(655.0, x1)) AS x0, greatest(0.0, least(655.0, x2)) AS x1, greatest(0.0, least(1200.0, y1)) AS y0,
         greatest(0.0, least(1200.0, y2)) AS y1, round_even(greatest(0.0, least(655.0, xc)), 3) AS px, round_even(greatest(0.0, least(1200.0, yc)), 3) AS py
  FROM v_boxes) WHERE x1 - x0 >= 5 AND y1 - y0 >= 5"""))
def rects_and_points(spark, sf):
    swapped = views.boxes(spark, sf).select(
        "img", "box_id", "xc", "yc", F.col("x2").alias("x0"), F.col("y2").alias("y0"), F.col("x1"), F.col("y1")
    )
    point = M.clamp_point(F.col("xc"), F.col("yc"), 655, 1200)
    return M.normalize_rect(swapped, 655, 1200).withColumn("p", point).select(
        "img", "box_id", *[r6(c).alias(c) for c in ("x0", "y0", "x1", "y1")], F.col("p.x").alias("px"), F.col("p.y").alias("py")
    )


@query("b24_crop_box", """
WITH c AS (SELECT o_orderkey, greatest(1.0, round_even(2048.0::DOUBLE / z, 0)) AS cw, greatest(1.0, round_even(1536.0::DOUBLE / z, 0)) AS ch, o
           FROM (SELECT o_orderkey, 1.0::DOUBLE + (o_orderkey % 5) * 0.5::DOUBLE AS z, (o_orderkey % 9 - 4) * 0.125::DOUBLE AS o FROM orders))
SELECT o_orderkey, greatest(0.0, least(2048.0 - cw, round_even(1024.0 + o * cw - cw / 2.0, 0))) AS "left",
       greatest(0.0, least(1536.0 - ch, round_even(768.0 - o * ch - ch / 2.0, 0))) AS top,
       greatest(0.0, least(2048.0 - cw, round_even(1024.0 + o * cw - cw / 2.0, 0))) + cw AS "right",
       greatest(0.0, least(1536.0 - ch, round_even(768.0 - o * ch - ch / 2.0, 0))) + ch AS bottom FROM c""")
def crop_box(spark, sf):
    key = F.col("o_orderkey")
    shift = (key % 9 - 4) * F.lit(0.125)
    framing = views.table(spark, sf, "orders").select(
        "o_orderkey", F.lit(2048).alias("src_width"), F.lit(1536).alias("src_height"),
        (F.lit(1.0) + (key % 5) * F.lit(0.5)).alias("zoom_factor"), shift.alias("offset_x"), (-shift).alias("offset_y"),
    )
    return M.crop_box(framing).select("o_orderkey", "left", "top", "right", "bottom")


@query("b25_effective_config", """
WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 90 AS INTEGER) END AS zoom,
                  CASE c_custkey % 4 WHEN 0 THEN ' Legacy' WHEN 1 THEN 'prezoom_pan_tilt_zoom' WHEN 2 THEN 'spiral' END AS s,
                  CASE WHEN c_custkey % 5 = 0 THEN false END AS fw, CASE WHEN c_custkey % 2 = 0 THEN '1280x720' END AS resolution FROM customer)
SELECT c_custkey, coalesce(resolution, '2048x1536') AS resolution,
       CASE WHEN s IS NULL OR s = ' Legacy' THEN 'zoom_then_pan_tilt' WHEN s LIKE 'prezoom%' THEN 'pre_move_zoom_then_pan_tilt_then_zoom' END AS sequence,
       CASE WHEN coalesce(fw, true) THEN CAST(n_regionkey AS INTEGER) ELSE coalesce(zoom, CAST(n_nationkey AS INTEGER)) END AS zoom
FROM c JOIN nation ON c_nationkey = n_nationkey""")
def effective_config(spark, sf):
    key = F.col("c_custkey")
    cameras = views.table(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("nation"),
        F.when(key % 3 == 0, (key % 90).cast("int")).alias("zoom"),
        F.when(key % 4 == 0, " Legacy").when(key % 4 == 1, "prezoom_pan_tilt_zoom").when(key % 4 == 2, "spiral").alias("sequence"),
        F.when(key % 5 == 0, False).alias("force_wide"), F.lit(None).cast("int").alias("capture_zoom"),
        F.when(key % 2 == 0, "1280x720").alias("resolution"),
    )
    general = views.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("nation"), F.col("n_nationkey").cast("int").alias("zoom"),
        F.lit("default").alias("sequence"), F.lit(None).cast("boolean").alias("force_wide"),
        F.col("n_regionkey").cast("int").alias("capture_zoom"), F.lit("2048x1536").alias("resolution"),
    )
    fields = ["zoom", "sequence", "force_wide", "capture_zoom", "resolution"]
    return M.effective_config(cameras, general, "nation", fields).select("c_custkey", "resolution", "sequence", "zoom")


ISO = """strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 4 WHEN 0 THEN '-06:00' WHEN 1 THEN 'Z' WHEN 2 THEN '' ELSE '??' END"""


def iso_text(df):
    tail = F.when(F.col("event_id") % 4 == 0, "-06:00").when(F.col("event_id") % 4 == 1, "Z").when(F.col("event_id") % 4 == 2, "").otherwise("??")
    return F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), tail)


@query("b26_parse_times", f"""
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE strftime(ts + CASE WHEN event_id % 4 = 0 THEN INTERVAL 6 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M:%S') END AS utc,
       CASE WHEN event_id % 4 = 3 THEN 'No time' ELSE strftime(ts, '%Y-%m-%d %H:00') END AS hour, substring({ISO}, 1, 10) AS day FROM events""")
def parse_times(spark, sf):
    texts = views.table(spark, sf, "events").withColumn("raw", iso_text(None))
    return texts.select(
        "event_id", F.date_format(S.parse_iso_utc(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("utc"),
        S.hour_label(F.col("raw")).alias("hour"), S.captured_date(F.col("raw")).alias("day"),
    )


@query("b31_ptz_reached", """
SELECT event_id, abs(value - 10.0) <= 8.0 AND abs(value * 0.05::DOUBLE - 0.5::DOUBLE) <= 0.8 AND abs(value * 0.1::DOUBLE - 1.57::DOUBLE) <= 0.8 AS reached_target FROM events""")
def ptz_reached(spark, sf):
    v = F.col("value")
    rows = views.table(spark, sf, "events").select(
        "event_id", v.alias("actual_zoom"), F.lit(10.0).alias("target_zoom"), (v * F.lit(0.05)).alias("actual_pan"),
        F.lit(0.5).alias("target_pan"), (v * F.lit(0.1)).alias("actual_tilt"), F.lit(1.57).alias("target_tilt"),
    )
    return M.ptz_reached(rows).select("event_id", "reached_target")


@query("b32_weighted_vector_distance", """
SELECT a.vec_id, round(coalesce(sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i:
  ((a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * CASE WHEN i % 3 = 1 THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END)
  * ((a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * CASE WHEN i % 3 = 1 THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END)))), 999.0), 6) AS distance
FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def weighted_vector_distance(spark, sf):
    vectors = views.table(spark, sf, "embeddings").select("vec_id", "embedding")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    weights = F.transform(F.col("embedding"), lambda _, i: F.when(i % 3 == 0, 0.2).otherwise(1.0))
    return vectors.join(after, "vec_id", "left").select(
        "vec_id", r6(M.weighted_distance(F.col("embedding"), F.col("other"), weights)).alias("distance")
    )
