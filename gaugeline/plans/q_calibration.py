"""Queries on calibrations: one per supplier, with points, guide lines and regions."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from gaugeline.operators import calibration as A
from gaugeline.plans import views
from gaugeline.plans.registry import query, r6
from gaugeline.plans.views import NEEDS, VIEWS, sql
from gaugeline.session import fresh_path
from gaugeline.sources import scans

# label, x, y and the suppliers (rest of five) that have the point
POINTS = [
    ("top_01", "100 + k % 17", "200 + k % 5", "1, 3"), ("top_02", "1500 - k % 13", "180 + k % 7", "1, 3"), ("base_01", "80 + k % 11", "1300 - k % 9", "1"),
    ("base_02", "1560 + k % 3", "1340 - k % 6", "1"), ("mark_01", "110 + k % 17", "900", "3"), ("mark_02", "1480 - k % 13", "910", "3"),
    ("top_03", "300 + k % 17", "210", "2"), ("top_04", "1300 - k % 13", "195", "2"), ("mark_06", "310 + k % 17", "1000", "2"), ("mark_05", "1290 - k % 13", "990", "2"),
    ("mark_03", "700", "600 + k % 10", "0, 1, 2, 3, 4"), ("mark_04", "1100", "610", "0, 1, 2, 3, 4"),
]
# kind, label, x1, y1, x2, y2, known length, test
LINES = [
    ("horizontal_ref", "Top_Ref", "90", "205 + k % 5", "1600", "190", "NULL", "true"), ("horizontal_ref", "bottom_horizontal", "1570 + k % 40", "1330", "70", "1310", "NULL", "true"),
    ("vertical_ref", "v1", "305", "100", "312", "1400", "NULL", "k % 2 = 0"), ("vertical_ref", "v2", "800", "100", "805", "1400", "NULL", "k % 2 = 0"),
    ("vertical_ref", "v3", "1295", "120", "1288", "1380", "NULL", "k % 2 = 0"), ("warp_scale_ref", "scale", "100", "50", "400 + k % 9", "50", "10 + k % 5", "k % 3 > 0"),
    ("horizontal_ref", "", "200", "700", "900", "705", "38.75", "k % 3 = 1"),
]
CORNER = {"tlx": "100 + k % 17", "tly": "200 + k % 5", "trx": "1500 - k % 13", "try": "180 + k % 7", "blx": "80 + k % 11", "bly": "1300 - k % 9", "brx": "1560 + k % 3", "bry": "1340 - k % 6"}

VIEWS["v_cal"] = "SELECT s_suppkey AS k, 'cal_' || s_suppkey AS cal_id FROM supplier"
VIEWS["v_points"] = " UNION ALL ".join(
    f"SELECT cal_id, k, '{label}' AS label, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM v_cal WHERE k % 5 IN ({modes})" for label, x, y, modes in POINTS
)
VIEWS["v_quad"] = "SELECT cal_id, k, " + ", ".join(f'CAST({t} AS DOUBLE) AS "{n}"' for n, t in CORNER.items()) + " FROM v_cal"
NEEDS.update({"v_points": ["v_cal"], "v_quad": ["v_cal"]})


def calibrations(spark, sf):
    k = F.col("s_suppkey")
    override = F.expr("CASE WHEN k % 5 = 0 THEN array(" + ", ".join(f"struct(cast({CORNER[c + 'x']} AS double) AS x, cast({CORNER[c + 'y']} AS double) AS y)" for c in ("tl", "tr", "bl", "br")) + ") END")
    return views.table(spark, sf, "supplier").select(k.alias("k"), F.concat(F.lit("cal_"), k.cast("string")).alias("cal_id")).withColumn("src_points", override)


def points(spark, sf):
    entries = ", ".join(
        f"CASE WHEN k % 5 IN ({modes}) THEN struct({i} AS position, '{label}' AS label, cast({x} AS int) AS x, cast({y} AS int) AS y) END" for i, (label, x, y, modes) in enumerate(POINTS)
    )
    return calibrations(spark, sf).select("cal_id", F.expr(f"explode(array_compact(array({entries})))").alias("p")).select("cal_id", "p.*")


def lines(spark, sf):
    entries = ", ".join(
        f"CASE WHEN {test} THEN struct({i} AS position, 'line_{i}' AS id, '{kind}' AS kind, '{label}' AS label, cast({x1} AS int) AS x1, cast({y1} AS int) AS y1, cast({x2} AS int) AS x2, "
        f"cast({y2} AS int) AS y2, cast({known} AS double) AS real_distance, '' AS coordinate_space) END" for i, (kind, label, x1, y1, x2, y2, known, test) in enumerate(LINES)
    )
    return calibrations(spark, sf).select("cal_id", F.expr(f"explode(array_compact(array({entries})))").alias("p")).select("cal_id", "p.*")


def rois(spark, sf):
    entries = (
        "array(struct(0 AS position, 'roi_01' AS id, array(100, 300, 1200, 900 + k % 50) AS xyxy, '' AS note), "
        "struct(1 AS position, 'roi_02' AS id, array(150, 250, 1100, 700 + k % 30) AS xyxy, CASE WHEN k % 3 = 0 THEN 'Lower tubes' ELSE '' END AS note))"
    )
    return calibrations(spark, sf).withColumn("k", F.col("k").cast("int")).select("cal_id", F.expr(f"explode({entries})").alias("p")).select("cal_id", "p.*")


def quads(spark, sf):
    rows = calibrations(spark, sf).select("cal_id", "k", *[F.expr(f"cast({t} AS double)").alias(n) for n, t in CORNER.items()])
    given = lambda v: F.expr(f"CASE WHEN k % 4 = 1 THEN {v}D END")
    return rows.withColumns(
        {"rx0": given(-20.0), "ry0": given(-10.0), "rx1": given(1390.0), "ry1": given(1111.0), "exact": F.expr("k % 4 <> 2"), "mirror": F.expr("k % 2 = 1")}
    )


def homographies(spark, sf):
    return A.fit_homography(quads(spark, sf)).withColumn("side", F.expr("CASE WHEN k % 2 = 0 THEN '151' ELSE '152' END"))


def matrix_text(source: str, q: str, w: str, h: str, keep: str) -> str:
    """DuckDB text: h11..h33 of a quad (columns q + x0..y3) by the unit square map."""
    p = lambda n: f'"{q}{n}"'
    return f"""(SELECT {keep}, ({w} - 1) * (e - f * hh) / d33 AS h11, ({w} - 1) * (c * hh - b) / d33 AS h12, ({w} - 1) * (b * f - c * e) / d33 AS h13,
      ({h} - 1) * (f * g - d) / d33 AS h21, ({h} - 1) * (a - c * g) / d33 AS h22, ({h} - 1) * (c * d - a * f) / d33 AS h23, (d * hh - e * g) / d33 AS h31, (b * g - a * hh) / d33 AS h32, 1.0::DOUBLE AS h33,
      a, b, c, d, e, f, g, hh FROM (SELECT *, a * e - b * d AS d33 FROM (SELECT *, {p('trx')} - {p('tlx')} + g * {p('trx')} AS a, {p('blx')} - {p('tlx')} + hh * {p('blx')} AS b, {p('tlx')} AS c,
      {p('try')} - {p('tly')} + g * {p('try')} AS d, {p('bly')} - {p('tly')} + hh * {p('bly')} AS e, {p('tly')} AS f FROM (SELECT *,
      (({p('tlx')} - {p('trx')} - {p('blx')} + {p('brx')}) * ({p('bly')} - {p('bry')}) - ({p('blx')} - {p('brx')}) * ({p('tly')} - {p('try')} - {p('bly')} + {p('bry')})) / den AS g,
      (({p('trx')} - {p('brx')}) * ({p('tly')} - {p('try')} - {p('bly')} + {p('bry')}) - ({p('tlx')} - {p('trx')} - {p('blx')} + {p('brx')}) * ({p('try')} - {p('bry')})) / den AS hh
      FROM (SELECT *, ({p('trx')} - {p('brx')}) * ({p('bly')} - {p('bry')}) - ({p('blx')} - {p('brx')}) * ({p('try')} - {p('bry')}) AS den FROM {source})))))"""


HYP = "sqrt(({0}x - {1}x) * ({0}x - {1}x) + ({0}y - {1}y) * ({0}y - {1}y))"
VIEWS["v_hom"] = f"""
  WITH b AS (SELECT *, greatest(240.0, round_even(greatest({HYP.format('tl', 'tr')}, {HYP.format('bl', 'br')}), 0)) AS bw, greatest(320.0, round_even(greatest({HYP.format('tl', 'bl')}, {HYP.format('tr', 'br')}), 0)) AS bh FROM v_quad),
  r AS (SELECT *, CASE WHEN k % 4 = 1 THEN -20.0 WHEN k % 4 = 2 THEN -greatest(24.0, round_even(0.06 * bw, 0)) ELSE 0.0 END AS rx0, CASE WHEN k % 4 = 1 THEN -10.0 WHEN k % 4 = 2 THEN -round_even(0.01 * bh, 0) ELSE 0.0 END AS ry0,
               CASE WHEN k % 4 = 1 THEN 1390.0 WHEN k % 4 = 2 THEN bw - 1 + greatest(140.0, round_even(0.55 * bw, 0)) ELSE bw - 1 END AS rx1, CASE WHEN k % 4 = 1 THEN 1111.0 WHEN k % 4 = 2 THEN bh - 1 + round_even(0.01 * bh, 0) ELSE bh - 1 END AS ry1 FROM b),
  m AS {matrix_text('r', '', 'bw', 'bh', 'cal_id, k, bw, bh, rx0, ry0, rx1, ry1')},
  u AS (SELECT *, rx0 / (bw - 1) AS u0, rx1 / (bw - 1) AS u1, ry0 / (bh - 1) AS v0, ry1 / (bh - 1) AS v1, greatest(80.0, round_even(rx1 - rx0, 0)) AS ow, greatest(80.0, round_even(ry1 - ry0, 0)) AS oh FROM m),
  s AS (SELECT cal_id, k, ow, oh, {', '.join(f'({n} * u{i} + {o} * v{j} + {p}) / (g * u{i} + hh * v{j} + 1) AS "q{name}{axis}"' for name, i, j in (('tl', 0, 0), ('tr', 1, 0), ('bl', 0, 1), ('br', 1, 1)) for axis, n, o, p in (('x', 'a', 'b', 'c'), ('y', 'd', 'e', 'f')))} FROM u),
  n AS {matrix_text('s', 'q', 'ow', 'oh', 'cal_id, k, ow, oh')}
  SELECT cal_id, k, ow, oh, h21, h22, h23, h31, h32, h33, CASE WHEN k % 2 = 1 THEN (ow - 1) * h31 - h11 ELSE h11 END AS h11, CASE WHEN k % 2 = 1 THEN (ow - 1) * h32 - h12 ELSE h12 END AS h12,
         CASE WHEN k % 2 = 1 THEN (ow - 1) * h33 - h13 ELSE h13 END AS h13 FROM n"""
NEEDS["v_hom"] = ["v_quad"]


@query("b17_fit_homography", sql("v_hom", "SELECT cal_id, ow AS out_w, oh AS out_h, " + ", ".join(f"round({h}, 6) AS {h}" for h in A.MATRIX) + " FROM v_hom"))
def fit_homography(spark, sf):
    return homographies(spark, sf).select("cal_id", "out_w", "out_h", *[r6(h).alias(h) for h in A.MATRIX])


WX = "(h11 * {0} + h12 * {1} + h13) / (h31 * {0} + h32 * {1} + h33)"
WY = "(h21 * {0} + h22 * {1} + h23) / (h31 * {0} + h32 * {1} + h33)"


@query("b16_project_points", sql("v_hom", f"""
SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(1599.0, {WX.format('x', 'y')})), 5) AS px, round(greatest(0.0, least(1199.0, {WY.format('x', 'y')})), 5) AS py
FROM (SELECT l_orderkey, l_linenumber, 'cal_' || l_suppkey AS cal_id, 600.0::DOUBLE + l_tax * 1000.0::DOUBLE AS x, l_extendedprice / 70.0::DOUBLE AS y FROM lineitem) JOIN v_hom USING (cal_id)"""))
def project_points(spark, sf):
    facts = views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("cal_"), F.col("l_suppkey").cast("string")).alias("cal_id"), F.expr("600D + l_tax * 1000D").alias("x"), F.expr("l_extendedprice / 70D").alias("y")
    )
    projected = A.project_points(facts, homographies(spark, sf), "cal_id", (1600, 1200))
    return projected.select("l_orderkey", "l_linenumber", F.round("px", 5).alias("px"), F.round("py", 5).alias("py"))


ENDS = ("p1", "q1", "p2", "q2"), ("p3", "q3", "p4", "q4")


def meet(a: tuple, b: tuple) -> tuple[str, str]:
    """DuckDB text: where a line meets another, by the share of the first line up to the crossing."""
    (p1, q1, p2, q2), (p3, q3, p4, q4) = a, b
    across = f"(({p1} - {p2}) * ({q3} - {q4}) - ({q1} - {q2}) * ({p3} - {p4}))"
    share = f"(CASE WHEN abs{across} >= 0.00000001 THEN (({p1} - {p3}) * ({q3} - {q4}) - ({q1} - {q3}) * ({p3} - {p4})) / {across} END)"
    return f"({p1} + {share} * ({p2} - {p1}))", f"({q1} + {share} * ({q2} - {q1}))"


@query("b19_intersect_lines", "SELECT s_suppkey, round({0}, 6) AS x, round({1}, 6) AS y FROM (SELECT s_suppkey, (s_suppkey % 7)::DOUBLE AS p1, 10.0::DOUBLE AS q1, 100.0::DOUBLE AS p2, (20 + s_suppkey % 11)::DOUBLE AS q2, 5.0::DOUBLE AS p3, 0.0::DOUBLE AS q3, (5 + s_suppkey % 4 * 30)::DOUBLE AS p4, CASE WHEN s_suppkey % 4 = 0 THEN 0.0 ELSE 90.0 END::DOUBLE AS q4 FROM supplier)".format(*meet(*ENDS)))
def intersect_lines(spark, sf):
    ends = views.table(spark, sf, "supplier").selectExpr(
        "s_suppkey", "cast(s_suppkey % 7 AS double) p1", "10D q1", "100D p2", "cast(20 + s_suppkey % 11 AS double) q2", "5D p3", "0D q3", "cast(5 + s_suppkey % 4 * 30 AS double) p4",
        "CASE WHEN s_suppkey % 4 = 0 THEN 0D ELSE 90D END q4",
    )
    x, y = A.intersect(*ENDS)
    return ends.select("s_suppkey", r6(F.expr(x)).alias("x"), r6(F.expr(y)).alias("y"))


def cross_text(a: str, b: str) -> str:
    ends = lambda n: tuple(f"{n}_{e}" for e in ("x1", "y1", "x2", "y2"))
    return meet(ends(a), ends(b))


def quad_text() -> str:
    guide = lambda a, b: cross_text(a, b)
    sec = [guide("l", "t"), guide("r", "t"), guide("l", "b"), guide("r", "b")]
    pri = [guide("pl", "t"), guide("pr", "t"), guide("pl", "b"), guide("pr", "b")]
    flat = [("t_x1", "t_y1"), ("t_x2", "t_y2"), ("b_x1", "b_y1"), ("b_x2", "b_y2")]
    own = [(CORNER[c + "x"], CORNER[c + "y"]) for c in ("tl", "tr", "bl", "br")]
    columns = []
    for i, name in enumerate(("tl", "tr", "bl", "br")):
        for j, axis in enumerate("xy"):
            columns.append(f'round(CASE k % 5 WHEN 2 THEN {sec[i][j]} WHEN 3 THEN {pri[i][j]} WHEN 4 THEN {flat[i][j]} ELSE CAST({own[i][j]} AS DOUBLE) END, 6) AS "{name}{axis}"')
    return ", ".join(columns)


LOW = cross_text("p0", "b")
@query("b18_source_quad", sql("v_cal", f"""
WITH g AS (SELECT *, 90.0::DOUBLE AS t_x1, (205 + k % 5)::DOUBLE AS t_y1, 1600.0::DOUBLE AS t_x2, 190.0::DOUBLE AS t_y2, 70.0::DOUBLE AS b_x1, 1310.0::DOUBLE AS b_y1, (1570 + k % 40)::DOUBLE AS b_x2, 1330.0::DOUBLE AS b_y2,
  CASE WHEN k % 2 = 0 THEN 305.0 ELSE 300 + k % 17 END::DOUBLE AS l_x1, CASE WHEN k % 2 = 0 THEN 100.0 ELSE 210.0 END::DOUBLE AS l_y1, CASE WHEN k % 2 = 0 THEN 312.0 ELSE 310 + k % 17 END::DOUBLE AS l_x2, CASE WHEN k % 2 = 0 THEN 1400.0 ELSE 1000.0 END::DOUBLE AS l_y2,
  CASE WHEN k % 2 = 0 THEN 1288.0 ELSE 1300 - k % 13 END::DOUBLE AS r_x1, CASE WHEN k % 2 = 0 THEN 1380.0 ELSE 195.0 END::DOUBLE AS r_y1, CASE WHEN k % 2 = 0 THEN 1295.0 ELSE 1290 - k % 13 END::DOUBLE AS r_x2, CASE WHEN k % 2 = 0 THEN 120.0 ELSE 990.0 END::DOUBLE AS r_y2,
  (100 + k % 17)::DOUBLE AS pl_x1, (200 + k % 5)::DOUBLE AS pl_y1, (110 + k % 17)::DOUBLE AS pl_x2, 900.0::DOUBLE AS pl_y2, (1500 - k % 13)::DOUBLE AS p0_x1, (180 + k % 7)::DOUBLE AS p0_y1, (1480 - k % 13)::DOUBLE AS p0_x2, 910.0::DOUBLE AS p0_y2 FROM v_cal),
e AS (SELECT *, b_x2 > {LOW[0]} + 2 AS ext FROM g),
q AS (SELECT *, CASE WHEN ext THEN b_x2 ELSE p0_x1 END AS pr_x1, CASE WHEN ext THEN b_y2 ELSE p0_y1 END AS pr_y1, CASE WHEN ext THEN b_x2 + (p0_x2 - p0_x1) ELSE p0_x2 END AS pr_x2, CASE WHEN ext THEN b_y2 + (p0_y2 - p0_y1) ELSE p0_y2 END AS pr_y2 FROM e)
SELECT cal_id, ['override', 'corners', 'secondary', 'primary', 'horizontals'][k % 5 + 1] AS rule, {quad_text()} FROM q"""))
def source_quad(spark, sf):
    rows = A.source_quad(calibrations(spark, sf), points(spark, sf), lines(spark, sf))
    return rows.select("cal_id", "rule", *[r6(n).alias(n) for n in A.CORNERS])


@query("e21_nearest_guides", sql("v_cal", """
SELECT cal_id, CASE WHEN k % 2 = 0 THEN 305.0::DOUBLE END AS left_x, CASE WHEN k % 2 = 0 THEN 1288.0::DOUBLE END AS right_x FROM v_cal"""))
def nearest_guides(spark, sf):
    seeds = "named_struct('x1', {0}D, 'y1', 210D, 'x2', {1}D, 'y2', 1000D)"
    rows = A.line_table(lines(spark, sf)).withColumns(
        {"left_seed": F.expr(seeds.format(1300, 1290)), "right_seed": F.expr(seeds.format(300, 310)), "y_probe": F.lit(750.0)}
    )
    return A.nearest_guides(rows).select("cal_id", F.col("left_guide.x1").alias("left_x"), F.col("right_guide.x1").alias("right_x"))


@query("b20_mirror_x", sql("v_cal", """
SELECT cal_id, 1599 - (700) AS mark_x, 1599 - 1600 AS line_x, CASE WHEN k % 3 > 0 THEN 100 END AS warp_x, 1599 - 1200 AS roi_x0, 1599 - 100 AS roi_x1 FROM v_cal"""))
def mirror_x(spark, sf):
    marks = A.mirror_points(points(spark, sf), 1600, ["x"]).filter(F.col("label") == "mark_03").select("cal_id", F.col("x").alias("mark_x"))
    flipped = A.mirror_lines(lines(spark, sf), 1600).groupBy("cal_id").agg(
        F.expr("max(CASE WHEN label = 'Top_Ref' THEN x2 END)").alias("line_x"), F.expr("max(CASE WHEN label = 'scale' THEN x1 END)").alias("warp_x")
    )
    regions = A.mirror_rois(rois(spark, sf), 1600).filter(F.col("id") == "roi_01").select("cal_id", F.expr("xyxy[0]").alias("roi_x0"), F.expr("xyxy[2]").alias("roi_x1"))
    return marks.join(flipped, "cal_id").join(regions, "cal_id")


def bounds_text(x0: str, y0: str, x1: str, y1: str) -> str:
    corners = ((x0, y0), (x1, y0), (x1, y1), (x0, y1))
    xs, ys = ", ".join(WX.format(*p) for p in corners), ", ".join(WY.format(*p) for p in corners)
    return f"floor(least({xs})) AS bx0, floor(least({ys})) AS by0, ceil(greatest({xs})) AS bx1, ceil(greatest({ys})) AS by1"


@query("b21_project_roi", sql("v_hom", f"""
WITH b AS (SELECT cal_id, ow, oh, {bounds_text('100.0', '300.0', '1200.0', '(900.0 + k % 50)')} FROM v_hom),
h AS (SELECT *, greatest(0.0, least(by0 - greatest(220.0, round_even(0.28 * oh, 0), round_even(8.0 * greatest(2.0, by1 - by0), 0)), oh - 2)) AS wy0 FROM b)
SELECT cal_id, greatest(0.0, least(bx0 - 18, ow - 2)) AS wx0, wy0, ow AS wx1, greatest(wy0 + 2, least(by1 + greatest(16.0, round_even(1.5 * greatest(2.0, by1 - by0), 0)), oh)) AS wy1 FROM h"""))
def project_roi(spark, sf):
    first = rois(spark, sf).filter(F.col("id") == "roi_01")
    return A.project_roi(first.join(homographies(spark, sf), "cal_id")).select("cal_id", "wx0", "wy0", "wx1", "wy1")


@query("b22_full_view_rect", sql("v_hom", f"""
SELECT cal_id, bx0, by0, greatest(80.0, round_even(bx1 - bx0, 0)) AS view_w, greatest(80.0, round_even(by1 - by0, 0)) AS view_h FROM (SELECT cal_id, {bounds_text('0.0', '0.0', '1599.0', '1199.0')} FROM v_hom)"""))
def full_view_rect(spark, sf):
    return A.full_view_rect(homographies(spark, sf), 1600, 1200).select("cal_id", "bx0", "by0", "view_w", "view_h")


PAIRS = "(VALUES ('top_03', 'top_04', 38.75, 'top_03-04'), ('mark_05', 'mark_06', 38.75, 'mark_05-06'), ('mark_03', 'mark_04', 47.75, 'mark_03-04')) s(la, lb, inches, name)"
VIEWS["v_scales"] = f"""
  SELECT cal_id, name AS label, inches::DOUBLE AS distance_in, abs(bx - ax) AS distance_px FROM (
    SELECT h.cal_id, name, inches, {WX.format('a.x', 'a.y')} AS ax, {WX.format('b.x', 'b.y')} AS bx FROM v_points a JOIN v_points b USING (cal_id) JOIN {PAIRS} ON a.label = la AND b.label = lb JOIN v_hom h USING (cal_id) WHERE h.k % 2 = 0) WHERE abs(bx - ax) > 1e-6"""
NEEDS["v_scales"] = ["v_points", "v_hom"]


@query("e20_known_distance_pairs", sql("v_scales", "SELECT cal_id, label, distance_in, round(distance_px, 5) AS distance_px FROM v_scales"))
def known_distance_pairs(spark, sf):
    return A.known_distance_pairs(points(spark, sf), homographies(spark, sf)).select("cal_id", "label", "distance_in", F.round("distance_px", 5).alias("distance_px"))


@query("c9_px_per_in", sql("v_scales", f"""
WITH l AS (SELECT cal_id, (300 + k % 9) / (10.0 + k % 5)::DOUBLE AS r FROM v_hom WHERE k % 3 > 0 UNION ALL
  SELECT cal_id, abs({WX.format('900', '705')} - {WX.format('200', '700')}) / 38.75 AS r FROM v_hom WHERE k % 3 = 1 UNION ALL SELECT cal_id, distance_px / distance_in FROM v_scales)
SELECT cal_id, round(median(r), 5) AS px_per_in, count(*) AS samples FROM l GROUP BY 1"""))
def px_per_in(spark, sf):
    fitted = homographies(spark, sf)
    samples = A.line_scales(lines(spark, sf), fitted).unionByName(A.known_distance_pairs(points(spark, sf), fitted))
    return A.px_per_in(samples).select("cal_id", F.round("px_per_in", 5).alias("px_per_in"), "samples")


@query("f5_detection_roi", sql("v_cal", "SELECT cal_id, CASE WHEN k % 3 = 0 THEN 'roi_02' ELSE 'roi_01' END AS roi_id FROM v_cal"))
def detection_roi(spark, sf):
    return A.detection_roi(rois(spark, sf))


SAVED, SET, DERIVED = "2024-09-22 00:00:00", "2024-11-01 00:00:00", "2024-12-01 00:00:00"


@query("l4_calibration_profiles", f"""
WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_nationkey % 2 = 0 THEN '151' ELSE '152' END AS side, s_name, s_acctbal, TIMESTAMP '2024-01-01' + s_suppkey * INTERVAL 1 MINUTE AS t0, TIMESTAMP '{SAVED}' + s_suppkey * INTERVAL 1 MINUTE AS t1 FROM supplier),
v AS (SELECT side, 'cal_' || k AS profile_id, t0 AS f, CASE WHEN k % 2 = 0 THEN t1 END AS t, 'img_' || k AS image_name, 'p' || k AS src_points, k AS rois FROM s
  UNION ALL SELECT side, 'cal_' || k, t1, NULL, 'img_' || k || '_b', 'p' || k, k + 1 FROM s WHERE k % 2 = 0),
d AS (SELECT v.*, TIMESTAMP '{SET}' AS set_at FROM v JOIN (SELECT side, 'cal_' || max(k) AS profile_id FROM s WHERE s_acctbal > 5000 GROUP BY 1) c USING (side, profile_id) WHERE f <= TIMESTAMP '{SET}' AND (t IS NULL OR t > TIMESTAMP '{SET}')),
q AS (SELECT s.*, 'cam' || side || '_homography_20241201_000000_' || replace(s_name, '#', '_') AS id FROM s WHERE s_acctbal < 0),
n AS (SELECT q.side, id AS profile_id, TIMESTAMP '{DERIVED}' AS f, NULL::TIMESTAMP AS t, 'new_' || k AS image_name, 'q' || k AS src_points, b.rois, k FROM q
  JOIN (SELECT side, profile_id, rois FROM v WHERE t IS NULL UNION ALL SELECT side, NULL, rois FROM d) b ON b.side = q.side AND b.profile_id IS NOT DISTINCT FROM CASE WHEN k % 2 = 0 THEN 'cal_' || k END),
d2 AS (SELECT n.side, n.profile_id, n.f, n.image_name FROM n JOIN (SELECT side, max(k) AS k FROM n WHERE k % 3 = 0 GROUP BY 1) c USING (side, k)),
cur AS (SELECT 'before' AS as_of, side, profile_id, f, image_name FROM d
  UNION ALL SELECT 'after', side, profile_id, f, image_name FROM d2 UNION ALL SELECT 'after', side, profile_id, f, image_name FROM d WHERE side NOT IN (SELECT side FROM d2)),
listing AS (SELECT 'before' AS as_of, * FROM v WHERE f <= TIMESTAMP '{SET}' AND (t IS NULL OR t > TIMESTAMP '{SET}')
  UNION ALL SELECT 'after', * FROM v WHERE t IS NULL UNION ALL SELECT 'after', * EXCLUDE (k) FROM n)
SELECT r.as_of, r.side, r.profile_id, strftime(r.f, '%Y-%m-%d %H:%M:%S') AS updated_at, r.image_name, coalesce(r.profile_id = c.profile_id, false) AS is_current, r.rois
FROM listing r LEFT JOIN cur c ON c.as_of = r.as_of AND c.side = r.side
UNION ALL SELECT as_of, side, 'current_default', strftime(f, '%Y-%m-%d %H:%M:%S'), image_name, true, NULL FROM cur""")
def calibration_profiles(spark, sf):
    """Every supplier saves a profile, the even ones again; a default is set; profiles are derived from others and from the default."""
    k = F.col("s_suppkey")
    side = F.when(F.col("s_nationkey") % 2 == 0, "151").otherwise("152").alias("side")
    rows = views.table(spark, sf, "supplier")
    text = lambda form: F.concat(F.lit(form), k.cast("string"))
    at = lambda start: F.expr(f"timestamp_ntz'{start}' + make_dt_interval(0, 0, s_suppkey, 0)").alias("saved_at")
    first = rows.select(side, text("cal_").alias("profile_id"), at("2024-01-01 00:00:00"), text("img_").alias("image_name"), text("p").alias("src_points"), k.cast("bigint").alias("rois"))
    second = rows.filter(k % 2 == 0).select(side, text("cal_").alias("profile_id"), at(SAVED), F.concat(text("img_"), F.lit("_b")).alias("image_name"), text("p").alias("src_points"), (k + 1).cast("bigint").alias("rois"))
    versions = A.profile_versions(first.unionByName(second))
    when = lambda t: datetime.datetime.fromisoformat(t)
    ntz = lambda t: F.lit(t).cast("timestamp_ntz")
    none = versions.limit(0).select("side", "profile_id", F.col("valid_from").alias("set_at"), "image_name", "src_points", "rois", F.col("valid_from").alias("updated_at"))
    chosen = rows.filter(F.col("s_acctbal") > 5000).groupBy(side).agg(F.max_by(text("cal_"), k).alias("profile_id"))
    defaults = A.set_defaults(versions, none, chosen, ntz(when(SET)))
    requests = rows.filter(F.col("s_acctbal") < 0).select(
        side, k.alias("seq"), F.col("s_name").alias("name"), F.when(k % 2 == 0, text("cal_")).alias("base_id"), text("new_").alias("image_name"), text("q").alias("src_points"), (k % 3 == 0).alias("set_as_default")
    )
    after, pointers = A.save_profiles(versions, defaults, requests, ntz(when(DERIVED)))
    content = after.select("side", "profile_id", F.col("valid_from").alias("updated_at"), "rois")

    def listed(name, table, marks, t):
        return A.list_profiles(table, marks, ntz(when(t))).join(content, ["side", "profile_id", "updated_at"], "left").select(F.lit(name).alias("as_of"), "side", "profile_id", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "image_name", "is_current", "rois")

    return listed("before", versions, defaults, SET).unionByName(listed("after", after, pointers, DERIVED))


@query("a6_load_calibrations", """
SELECT 'cam_' || s_suppkey || '.jpg' AS image_name, CASE WHEN s_suppkey % 5 = 0 THEN 4 END AS n_src, 2 AS n_points, 'point_02' AS second_id, 'mark' AS first_kind, CAST(100 + s_suppkey AS INTEGER) AS x1, 38.75::DOUBLE AS real_distance FROM supplier""")
def load_calibrations(spark, sf):
    """One TOML file per supplier, written line by line and read back."""
    texts = calibrations(spark, sf).withColumn(
        "toml",
        F.expr(
            "concat_ws('\n', concat('image_name = \"cam_', k, '.jpg\"'), CASE WHEN k % 5 = 0 THEN 'src_points_override = [[1, 2], [3.5, 2], [1, 9], [4, 9]]' END, "
            "'[[points]]', 'label = \"top_01\"', concat('x = ', 100 + k), 'y = 7', '[[points]]', 'kind = \"corner\"', '[[lines]]', 'label = \"ref\"', concat('x1 = ', 100 + k), 'real_distance = 38.75')"
        ),
    )
    path = fresh_path(spark, "toml")
    rows = texts.select("cal_id", F.posexplode(F.split("toml", "\n")).alias("n", "value")).repartition("cal_id").sortWithinPartitions("cal_id", "n")
    rows.select("cal_id", "value").write.option("extension", "toml").option("quote", "").option("delimiter", "\u0001").partitionBy("cal_id").csv(path)
    loaded = scans.load_calibrations(spark, path)
    kinds = scans.calibration_rows(loaded, "points").filter(F.col("position") == 1).select("cal_id", F.col("id").alias("second_id"))
    return loaded.join(kinds, "cal_id").select(
        "image_name", F.when(F.col("src_points").isNotNull(), F.size("src_points")).alias("n_src"), F.size("points").alias("n_points"), "second_id",
        F.expr("points[0].kind").alias("first_kind"), F.expr("lines[0].x1").alias("x1"), F.expr("lines[0].real_distance").alias("real_distance"),
    )


INVERSE = {
    "g11": "h22 * h33 - h23 * h32", "g12": "h13 * h32 - h12 * h33", "g13": "h12 * h23 - h13 * h22", "g21": "h23 * h31 - h21 * h33", "g22": "h11 * h33 - h13 * h31",
    "g23": "h13 * h21 - h11 * h23", "g31": "h21 * h32 - h22 * h31", "g32": "h12 * h31 - h11 * h32", "g33": "h11 * h22 - h12 * h21",
}
BX = "round(round_even(greatest(0.0, least(1599.0, (g11 * {0} + g12 * {1} + g13) / (g31 * {0} + g32 * {1} + g33))), 3), 3)"
BY = "round(round_even(greatest(0.0, least(1199.0, (g21 * {0} + g22 * {1} + g23) / (g31 * {0} + g32 * {1} + g33))), 3), 3)"


@query("b29_marker_positions", sql("v_items v_hom", f"""
WITH m AS (SELECT CASE WHEN k % 2 = 0 THEN '151' ELSE '152' END AS side, {', '.join(f'arg_min({h}, k) AS {h}' for h in A.MATRIX)} FROM v_hom GROUP BY 1),
g AS (SELECT side, {', '.join(f'{text} AS {name}' for name, text in INVERSE.items())} FROM m),
p AS (SELECT *, 610.0::DOUBLE + offset_px AS cx, CASE tube_idx % 4 WHEN 0 THEN 611.0::DOUBLE + offset_px WHEN 1 THEN 609.0::DOUBLE + offset_px
        WHEN 2 THEN ((590.0::DOUBLE + offset_px) + (630.0::DOUBLE + offset_px)) * 0.5 ELSE CASE WHEN side = '152' THEN ref_x ELSE 610.0::DOUBLE + offset_px END END AS vx,
        CASE WHEN tube_idx % 4 = 2 THEN ((y_center - 9.0::DOUBLE) + (y_center + 9.0::DOUBLE)) * 0.5 ELSE y_center END AS vy FROM v_items)
SELECT run_id, side, tube_idx AS tube_number, tube_idx, {BX.format('vx', 'vy')} AS x, {BY.format('vx', 'vy')} AS y,
       CASE tube_idx % 4 WHEN 0 THEN 'refined_pipe_end' WHEN 1 THEN 'yolo_box_center' WHEN 2 THEN 'box_xyxy_center' ELSE CASE WHEN side = '152' THEN 'legacy_ref_fallback' ELSE 'legacy_calc_fallback' END END AS visual_source,
       {BX.format('cx', 'y_center')} AS calc_x, {BX.format('ref_x', 'y_center')} AS ref_x FROM p JOIN g USING (side)"""))
def marker_positions(spark, sf):
    """Markers of all measured items; the homography of each side is one of the fitted ones."""
    every = views.items(spark, sf)
    t = F.col("tube_idx")
    drawn = every.select(
        "run_id", "side", "tube_idx", "source_order", F.expr("610D + offset_px").alias("x"), "ref_x", F.col("y_center").alias("y"),
        F.when(t % 4 == 0, F.expr("611D + offset_px")).alias("refined_x"), F.when(t % 4 == 0, F.col("y_center")).alias("refined_y"),
        F.when(t % 4 == 1, F.expr("609D + offset_px")).alias("box_x"), F.when(t % 4 == 1, F.col("y_center")).alias("box_y"),
        F.when(t % 4 == 2, F.expr("590D + offset_px")).alias("x1"), F.when(t % 4 == 2, F.expr("y_center - 9D")).alias("y1"),
        F.when(t % 4 == 2, F.expr("630D + offset_px")).alias("x2"), F.when(t % 4 == 2, F.expr("y_center + 9D")).alias("y2"),
    )
    rows = every.select("run_id", "side", "tube_idx", t.alias("tube_number"), F.lit("matched").alias("match_status"))
    sides = homographies(spark, sf).groupBy("side").agg(
        *[F.min_by(h, "k").alias(h) for h in A.MATRIX]
    )
    return A.marker_positions(rows, drawn, sides, 1600, 1200)
