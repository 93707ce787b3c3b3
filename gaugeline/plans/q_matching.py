"""Queries on pairing both sides, and the flagship length table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import scalars as S
from gaugeline.operators import boxes as B
from gaugeline.operators import matching as P
from gaugeline.operators import measure as M
from gaugeline.plans import q_boxes, views
from gaugeline.plans.q_scalars import reference_table
from gaugeline.plans.registry import mid, query, r6
from gaugeline.plans.views import NEEDS, VIEWS, sql
from gaugeline.session import cut_lineage

SIDE = "PARTITION BY run_id, side"

VIEWS["v_active"] = f"""
  SELECT *, CAST(row_number() OVER ({SIDE} ORDER BY y_center, id) AS INTEGER) AS place FROM v_items WHERE active"""
NEEDS["v_active"] = ["v_items"]


def undetached(source: str, order: str) -> str:
    return f"""SELECT * FROM (SELECT *, max(CASE WHEN jump IS NULL OR jump < 4 THEN nth END) OVER ({SIDE}) AS last_at
    FROM (SELECT *, row_number() OVER u AS nth, slot - lag(slot) OVER u AS jump FROM {source}
          WINDOW u AS ({SIDE} ORDER BY slot, {order}))) WHERE nth <= last_at"""


def central(gap: str, low: float, high: float, source: str) -> str:
    """Adds ``pitch``: the median of the central gaps, else of all gaps."""
    return f"""(SELECT *, coalesce({mid('near')}, {mid('every')}) AS pitch FROM (
      SELECT *, list_sort(list({gap}) FILTER (WHERE {gap} BETWEEN {low} * {mid('every')} AND {high} * {mid('every')}) OVER ({SIDE})) AS near
      FROM (SELECT *, list_sort(list({gap}) FILTER (WHERE {gap} > 1e-6) OVER ({SIDE})) AS every FROM {source})))"""


LOCAL = ("(1.05 * CASE WHEN lag(box_height) OVER up IS NULL THEN box_height ELSE 0.5 * (lag(box_height) OVER up + box_height) END)")
VIEWS["v_pitched"] = f"""
  SELECT * FROM {central('gap', 0.45, 1.85, f"(SELECT *, y_center - lag(y_center) OVER ({SIDE} ORDER BY place) AS gap FROM v_active)")}"""
VIEWS["v_vertical"] = undetached(f"""(
  SELECT *, CASE WHEN pitch > 1e-6 THEN CAST(sum(step) OVER ({SIDE} ORDER BY y_center DESC, place) AS INTEGER) ELSE place END AS slot FROM (
    SELECT *, CASE WHEN ratio >= 2.3 THEN greatest(1, CAST(round_even(ratio, 0) AS INTEGER)) ELSE 1 END AS step FROM (
      SELECT *, (lag(y_center) OVER up - y_center) / greatest({LOCAL}, pitch) AS ratio FROM v_pitched
      WINDOW up AS ({SIDE} ORDER BY y_center DESC, place))))""", "place DESC")
SHARE = f"""(SELECT a.*, greatest(0.0, least(1.0, (bounds_bottom - y_center) / (bounds_bottom - bounds_top))) AS share
  FROM v_active a JOIN v_datasets d USING (run_id, side) WHERE bounds_top IS NOT NULL)"""
VIEWS["v_bundle"] = undetached(f"""(
  SELECT *, greatest(1, CAST(round_even(share / pitch, 0) AS INTEGER) + 1) AS slot FROM {central('gap', 0.35, 2.25,
    f"(SELECT *, CASE WHEN jmp > 1e-6 THEN jmp END AS gap FROM (SELECT *, share - lag(share) OVER ({SIDE} ORDER BY share, place) AS jmp FROM {SHARE}))")}
  WHERE pitch > 1e-6)""", "place")
FIELDS = "run_id, side, slot, id, unmatched"
VIEWS["v_slots"] = f"""
  SELECT s.* FROM (SELECT {FIELDS}, place AS queue, true AS bundle FROM v_bundle UNION ALL
                   SELECT {FIELDS}, -place AS queue, false AS bundle FROM v_vertical) s
  JOIN (SELECT run_id, coalesce(n = 2, false) AS both_bundle FROM (SELECT DISTINCT run_id FROM v_vertical)
        LEFT JOIN (SELECT run_id, count(DISTINCT side) AS n FROM v_bundle GROUP BY 1) USING (run_id)) c
  ON c.run_id = s.run_id AND c.both_bundle = s.bundle"""
NEEDS.update({"v_pitched": ["v_active"], "v_vertical": ["v_pitched"], "v_bundle": ["v_active", "v_datasets"], "v_slots": ["v_vertical", "v_bundle"]})


def offsets(source: str) -> str:
    return f"""(SELECT run_id, CAST(CASE WHEN len(coalesce(l, [])) = 0 OR len(coalesce(r, [])) = 0 THEN 0 ELSE o END AS INTEGER) AS "offset" FROM (
      SELECT run_id, l, r, o, row_number() OVER (PARTITION BY run_id ORDER BY hits DESC, coalesce(len(l), 0) + coalesce(len(r), 0) - 2 * hits, beyond, abs(o), o) AS k
      FROM (SELECT *, len(list_intersect(l, list_transform(r, lambda s: s + o))) AS hits,
                   len(list_filter(r, lambda s: s + o > list_max(l) OR s + o < list_min(l))) AS beyond
            FROM (SELECT run_id, list(DISTINCT slot) FILTER (WHERE side = '151') AS l, list(DISTINCT slot) FILTER (WHERE side = '152') AS r
                  FROM {source} GROUP BY 1), (SELECT unnest([-2, -1, 0, 1, 2]) AS o))) WHERE k = 1)"""


PAIR = "CASE WHEN l.id IS NOT NULL AND r.id IS NOT NULL THEN 'matched' WHEN l.id IS NOT NULL THEN 'left_only' ELSE 'right_only' END"


def slot_rows(source: str) -> str:
    return f"""(WITH m AS (SELECT s.*, slot + CASE WHEN side = '152' THEN "offset" ELSE 0 END AS sl FROM {source} s JOIN {offsets(source)} USING (run_id)),
    t AS (SELECT *, sum(CASE WHEN unmatched THEN 0 ELSE 1 END) OVER q + CASE WHEN unmatched THEN 1 ELSE 0 END AS turn, row_number() OVER q AS rn
          FROM m WINDOW q AS (PARTITION BY run_id, side, sl ORDER BY queue, id)),
    l AS (SELECT * FROM t WHERE side = '151' AND NOT unmatched), r AS (SELECT * FROM t WHERE side = '152' AND NOT unmatched),
    p AS (SELECT coalesce(l.run_id, r.run_id) AS run_id, coalesce(l.sl, r.sl) AS sl, coalesce(l.turn, r.turn) AS turn, 2 AS phase, 0 AS rn,
                 {PAIR} AS match_status, l.id AS id_151, r.id AS id_152
          FROM l FULL JOIN r ON l.run_id = r.run_id AND l.sl = r.sl AND l.turn = r.turn
          UNION ALL SELECT run_id, sl, turn, 0, rn, 'left_only_manual', id, NULL FROM t WHERE side = '151' AND unmatched
          UNION ALL SELECT run_id, sl, turn, 1, rn, 'right_only_manual', NULL, id FROM t WHERE side = '152' AND unmatched)
    SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY sl DESC, turn, phase, rn) AS INTEGER) AS tube_number, match_status, id_151, id_152 FROM p)"""


ORDER_ROWS = f"""(SELECT coalesce(l.run_id, r.run_id) AS run_id, coalesce(l.place, r.place) AS tube_number,
    CASE WHEN l.unmatched THEN 'left_only_manual' WHEN r.unmatched THEN 'right_only_manual' ELSE {PAIR} END AS match_status,
    CASE WHEN coalesce(l.unmatched, false) OR NOT coalesce(r.unmatched, false) THEN l.id END AS id_151,
    CASE WHEN NOT coalesce(l.unmatched, false) THEN r.id END AS id_152
    FROM (SELECT * FROM v_active WHERE side = '151') l FULL JOIN (SELECT * FROM v_active WHERE side = '152') r
    ON l.run_id = r.run_id AND l.place = r.place)"""

VIEWS["v_order_rows"] = f"SELECT * FROM {ORDER_ROWS}"
VIEWS["v_slot_rows"] = f"SELECT * FROM {slot_rows('v_slots')}"
VIEWS["v_runs"] = """
  SELECT *, CASE WHEN bundle AND use_order THEN 'yolo_vertical_order_balanced_with_sam_bundle_bounds'
       WHEN bundle THEN 'sam_bundle_normalized_vertical_slots' WHEN use_order THEN 'yolo_vertical_order_balanced'
       ELSE 'auto_vertical_slot_alignment_local_box_pitch_cam151_number_anchor' END AS strategy FROM (
    SELECT *, least(n151, n152) / greatest(n151, n152)::DOUBLE AS count_ratio,
           modelled AND least(n151, n152) >= 8 AND least(n151, n152) / greatest(n151, n152)::DOUBLE >= 0.7 AND order_matched > slot_matched AS use_order
    FROM (SELECT run_id, count(*) FILTER (WHERE side = '151') AS n151, count(*) FILTER (WHERE side = '152') AS n152,
                 run_id::BIGINT % 2 = 0 AND count(DISTINCT side) = 2 AS modelled FROM v_active GROUP BY 1)
    JOIN (SELECT run_id, count(*) FILTER (WHERE match_status = 'matched') AS order_matched FROM v_order_rows GROUP BY 1) USING (run_id)
    JOIN (SELECT run_id, count(*) FILTER (WHERE match_status = 'matched') AS slot_matched FROM v_slot_rows GROUP BY 1) USING (run_id)
    JOIN (SELECT run_id, bool_or(bundle) AS bundle FROM v_slots GROUP BY 1) USING (run_id))"""
VIEWS["v_rows"] = """
  SELECT m.*, a.tube_idx AS tube_idx_151, a.distance_in AS measurement_151, b.tube_idx AS tube_idx_152, b.distance_in AS measurement_152,
         b.relative_position AS r152_position, a.notes AS notes_151, b.notes AS notes_152, strategy,
         a.distance_in - 47.75::DOUBLE AS r151, CASE WHEN b.relative_position = 'before' THEN 41.0::DOUBLE - b.distance_in ELSE 41.0::DOUBLE + b.distance_in END AS r152
  FROM (SELECT s.*, strategy FROM v_slot_rows s JOIN v_runs USING (run_id) WHERE NOT use_order
        UNION ALL SELECT o.*, strategy FROM v_order_rows o JOIN v_runs USING (run_id) WHERE use_order) m
  LEFT JOIN v_items a ON a.run_id = m.run_id AND a.id = m.id_151 LEFT JOIN v_items b ON b.run_id = m.run_id AND b.id = m.id_152"""
VIEWS["v_lengths"] = "SELECT *, 408.5::DOUBLE + r151 + r152 AS total FROM v_rows"
NEEDS.update({
    "v_order_rows": ["v_active"], "v_slot_rows": ["v_slots"], "v_runs": ["v_order_rows", "v_slot_rows"],
    "v_rows": ["v_runs", "v_items"], "v_lengths": ["v_rows"],
})


def ordered(spark, sf):
    return P.active_order(P.by_run(views.items(spark, sf)))


def slots(spark, sf):
    """Chosen slots, written once: the pairing needs them both as sets and as rows."""
    return cut_lineage(P.chosen_slots(cut_lineage(ordered(spark, sf)), views.datasets(spark, sf)))


def matched(spark, sf):
    return P.match_runs(views.items(spark, sf), views.datasets(spark, sf))


@query("d27_active_order", sql("v_active", "SELECT run_id, side, id, place FROM v_active"))
def active_order(spark, sf):
    return ordered(spark, sf).select("run_id", "side", "id", "place")


@query("b33_slot_increment", sql("v_pitched", f"""
SELECT run_id, side, id, CASE WHEN ratio >= 2.3 THEN greatest(1, CAST(round_even(ratio, 0) AS INTEGER)) ELSE 1 END AS step FROM (
  SELECT *, (lag(y_center) OVER up - y_center) / greatest({LOCAL}, pitch) AS ratio FROM v_pitched
  WINDOW up AS ({SIDE} ORDER BY y_center DESC, place))"""))
def slot_increment(spark, sf):
    from pyspark.sql import Window

    up = Window.partitionBy("run_id", "side").orderBy(F.col("y_center").desc(), "place")
    rows = P.with_pitch(ordered(spark, sf))
    gap = F.lag("y_center").over(up) - F.col("y_center")
    step = P.slot_increment(gap, F.lag("box_height").over(up), F.col("box_height"), F.col("pitch"))
    return rows.select("run_id", "side", "id", step.alias("step"))


@query("d24_vertical_slots", sql("v_vertical", "SELECT run_id, side, id, slot FROM v_vertical"))
def vertical_slots(spark, sf):
    return P.vertical_slots(ordered(spark, sf)).select("run_id", "side", "id", "slot")


@query("d25_bundle_slots", sql("v_bundle", "SELECT run_id, side, id, round(share, 6) AS share, slot FROM v_bundle"))
def bundle_slots(spark, sf):
    slots = P.bundle_slots(ordered(spark, sf), views.datasets(spark, sf))
    return slots.select("run_id", "side", "id", r6("share").alias("share"), "slot")


@query("e9_best_slot_offset", sql("v_slots", f'SELECT * FROM {offsets("v_slots")}'))
def best_slot_offset(spark, sf):
    return P.best_slot_offset(slots(spark, sf))


VIEWS["v_slot_sets"] = """
  SELECT run_id, coalesce(list(DISTINCT slot) FILTER (WHERE side = '151'), []) AS l, coalesce(list(DISTINCT slot) FILTER (WHERE side = '152'), []) AS r
  FROM v_slots GROUP BY 1"""
NEEDS["v_slot_sets"] = ["v_slots"]


@query("g2_slot_set_operations", sql("v_slot_sets", """
SELECT run_id, len(list_intersect(l, r))::INTEGER AS shared, (len(l) + len(r) - 2 * len(list_intersect(l, r)))::INTEGER AS differing FROM v_slot_sets"""))
def slot_set_operations(spark, sf):
    slots = P.chosen_slots(ordered(spark, sf), views.datasets(spark, sf))
    side = lambda s: F.collect_set(F.when(F.col("side") == s, F.col("slot")))
    sets = slots.groupBy("run_id").agg(side("151").alias("l"), side("152").alias("r"))
    differing = F.size(F.array_except("l", "r")) + F.size(F.array_except("r", "l"))
    return sets.select("run_id", F.size(F.array_intersect("l", "r")).alias("shared"), differing.alias("differing"))


ROW = "run_id, tube_number, match_status, id_151, id_152"


@query("e7_slot_match", sql("v_slot_rows", f"SELECT {ROW} FROM v_slot_rows"))
def slot_match(spark, sf):
    return P.slot_match(slots(spark, sf)).select(*ROW.split(", "))


@query("e8_order_match", sql("v_order_rows", f"SELECT {ROW} FROM v_order_rows"))
def order_match(spark, sf):
    return P.order_match(ordered(spark, sf)).select(*ROW.split(", "))


@query("e10_select_strategy", sql("v_rows", """
SELECT run_id, tube_number, match_status, id_151, id_152, tube_idx_151, tube_idx_152, round(measurement_151, 6) AS measurement_151,
       round(measurement_152, 6) AS measurement_152, r152_position, strategy FROM v_rows"""))
def select_strategy(spark, sf):
    rows, _ = matched(spark, sf)
    return rows.select(
        *ROW.split(", "), "tube_idx_151", "tube_idx_152", r6("measurement_151").alias("measurement_151"),
        r6("measurement_152").alias("measurement_152"), "r152_position", "strategy",
    )


@query("e10_match_headers", sql("v_runs", """
SELECT run_id, n151, n152, order_matched, slot_matched, bundle, round(count_ratio, 6) AS count_ratio, strategy FROM v_runs"""))
def match_headers(spark, sf):
    _, header = matched(spark, sf)
    return header.select(
        "run_id", "n151", "n152", "order_matched", "slot_matched", "bundle", r6("count_ratio").alias("count_ratio"), "strategy"
    )


@query("c5_match_summary", sql("v_rows", """
SELECT run_id, matched, left_only, right_only, inactive_151, inactive_152, manual_unmatched_151, manual_unmatched_152 FROM (
  SELECT run_id, count(*) FILTER (WHERE side = '151' AND NOT active) AS inactive_151, count(*) FILTER (WHERE side = '152' AND NOT active) AS inactive_152,
         count(*) FILTER (WHERE side = '151' AND active AND unmatched) AS manual_unmatched_151,
         count(*) FILTER (WHERE side = '152' AND active AND unmatched) AS manual_unmatched_152 FROM v_items GROUP BY 1)
LEFT JOIN (SELECT run_id, count(*) FILTER (WHERE match_status = 'matched') AS matched, count(*) FILTER (WHERE match_status LIKE 'left%') AS left_only,
                  count(*) FILTER (WHERE match_status LIKE 'right%') AS right_only FROM v_rows GROUP BY 1) USING (run_id)"""))
def match_summary(spark, sf):
    rows, _ = matched(spark, sf)
    return P.match_summary(rows, P.by_run(views.items(spark, sf)))


@query("b12_observations", sql("v_rows", """
SELECT run_id, tube_number, concat_ws(' | ', CASE WHEN notes_151 <> '' THEN '151: ' || notes_151 END, CASE WHEN notes_152 <> '' THEN '152: ' || notes_152 END,
  CASE match_status WHEN 'left_only_manual' THEN 'Sin match manual en 151' WHEN 'right_only_manual' THEN 'Sin match manual en 152'
       WHEN 'left_only' THEN 'Falta medicion del lado 152' WHEN 'right_only' THEN 'Falta medicion del lado 151' END) AS observations FROM v_rows"""))
def observations(spark, sf):
    rows, _ = matched(spark, sf)
    return rows.select("run_id", "tube_number", "observations")


VIEWS["v_display"] = """
  SELECT run_id, tube_number, match_status, round(total, 6) AS length_in,
         CASE WHEN match_status <> 'matched' OR total IS NULL THEN 'X' WHEN total >= 493 THEN 'A' WHEN total >= 491 THEN 'B' ELSE 'C' END AS length_group,
         CASE WHEN match_status = 'matched' THEN '#54b8ff' ELSE '#f2a84b' END AS color FROM v_lengths"""
NEEDS["v_display"] = ["v_lengths"]
SHOWN = ["run_id", "tube_number", "match_status", "length_in", "length_group", "color"]


def display(spark, sf):
    rows, _ = matched(spark, sf)
    return M.display_rows(M.match_values(rows)).withColumn("length_in", r6("length_in"))


@query("b14_display_rows", sql("v_display", "SELECT run_id, tube_number, match_status, length_in, color, CASE WHEN length_in IS NULL THEN '-' ELSE printf('%.2f', round_even(length_in, 2)) END AS length_in_display FROM v_display"))
def display_rows(spark, sf):
    return display(spark, sf).select("run_id", "tube_number", "match_status", "length_in", "color", "length_in_display")


@query("b15_length_group", sql("v_display", "SELECT match_status, length_group, color, count(*) AS n FROM v_display GROUP BY ALL"))
def length_group(spark, sf):
    return display(spark, sf).groupBy("match_status", "length_group", "color").agg(F.count(F.lit(1)).alias("n"))


@query("b34_marker_color", sql("v_rows", """
SELECT match_status, CASE WHEN match_status = 'matched' THEN '#54b8ff' ELSE '#f2a84b' END AS color, count(*) AS n FROM v_rows GROUP BY ALL"""))
def marker_color(spark, sf):
    rows, _ = matched(spark, sf)
    return rows.groupBy("match_status", S.marker_color(F.col("match_status")).alias("color")).agg(F.count(F.lit(1)).alias("n"))


@query("c15_length_percent", sql("v_display", """
SELECT run_id, tube_number, round(CASE WHEN length_in IS NULL THEN 42.0 ELSE greatest(18.0, least(100.0, length_in
       / max(length_in) OVER (PARTITION BY run_id) * 100)) END, 4) AS width_percent FROM v_display"""))
def length_percent(spark, sf):
    from gaugeline.operators.statistics import length_percent as percent

    return percent(display(spark, sf)).select("run_id", "tube_number", F.round("width_percent", 4).alias("width_percent"))


@query("f6_first_ten", sql("v_display", "SELECT run_id, tube_number, length_group FROM v_display WHERE tube_number BETWEEN 1 AND 10"))
def first_ten(spark, sf):
    return display(spark, sf).filter(F.col("tube_number").between(1, 10)).orderBy("run_id", "tube_number").select(
        "run_id", "tube_number", "length_group"
    )


@query("a15_audit_rows", sql("v_items", """
SELECT side, run_id, id, tube_idx, round(distance_in, 6) AS distance_in, relative_position, active, unmatched, notes FROM v_items"""))
def audit_rows(spark, sf):
    return P.audit_rows(views.items(spark, sf)).withColumn("distance_in", r6("distance_in"))



@query("b27_bundle_bounds", sql("v_datasets", """
SELECT run_id, side, round(CASE WHEN n % 3 = 0 THEN 100.0 ELSE bounds_top END, 6) AS low, round(CASE WHEN n % 3 = 0 THEN 900.0 ELSE bounds_bottom END, 6) AS high
FROM v_datasets"""))
def bundle_bounds(spark, sf):
    interval = lambda a, b: F.struct(a.alias("top"), b.alias("bottom"))
    candidates = F.array(
        interval(F.lit(500.0), F.lit(500.0)), interval(F.col("bounds_bottom"), F.col("bounds_top")), interval(F.lit(900.0), F.lit(100.0))
    )
    b = P.bundle_bounds(candidates)
    return views.datasets(spark, sf).select("run_id", "side", r6(b["low"]).alias("low"), r6(b["high"]).alias("high"))


@query("b35_bottom_anchor", sql("v_datasets v_pitched", """
SELECT run_id, side, round(coalesce(roi_y + roi_h, image_h, lowest), 6) AS anchor_y FROM v_datasets
LEFT JOIN (SELECT run_id, side, max(y_center) + 0.5 * coalesce(any_value(pitch), 0) AS lowest FROM v_pitched GROUP BY 1, 2) USING (run_id, side)"""))
def bottom_anchor(spark, sf):
    anchors = P.bottom_anchor(views.datasets(spark, sf), views.items(spark, sf))
    return anchors.select("run_id", "side", r6("anchor_y").alias("anchor_y"))


@query("b28_viewer_positions", sql("v_items v_datasets", """
WITH j AS (SELECT i.*, coalesce(image_w, 640.0) AS iw, coalesce(image_h, 480.0) AS ih, n % 4 = 0 AND n % 5 <> 0 AS crop,
                  row_number() OVER w - 1 AS nth, count(*) OVER (PARTITION BY run_id, side) AS cnt
           FROM v_items i JOIN v_datasets d USING (run_id, side) WINDOW w AS (PARTITION BY run_id, side ORDER BY source_order, tube_idx, id)),
p AS (SELECT *, greatest(42.0, ih * 0.07) AS pad, CASE WHEN crop THEN 10.0 ELSE 0.0 END AS ox, CASE WHEN crop THEN 20.0 ELSE 0.0 END AS oy FROM j),
v AS (SELECT *, CASE WHEN tube_idx % 5 = 0 THEN 0.5 * iw ELSE (610.0 + CASE WHEN tube_idx % 3 = 0 THEN 0 ELSE offset_px END) - ox END AS x,
                CASE WHEN tube_idx % 4 = 0 THEN CASE WHEN cnt = 1 THEN 0.5 * ih ELSE ih - pad - nth * ((ih - pad - pad) / greatest(cnt - 1, 1)) END ELSE y_center - oy END AS y FROM p)
SELECT run_id, side, id, round(round_even(greatest(18.0, least(greatest(18.0, iw - 18.0), x)), 3), 3) AS x,
       round(round_even(greatest(18.0, least(greatest(18.0, ih - 18.0), y)), 3), 3) AS y,
       CASE WHEN tube_idx % 5 <> 0 THEN 610.0::DOUBLE - ox END AS ref_x FROM v"""))
def viewer_positions(spark, sf):
    t = F.col("tube_idx")
    drawn = views.items(spark, sf).select(
        "run_id", "side", "id", "tube_idx", "source_order",
        F.when((t % 3 != 0) & (t % 5 != 0), 610.0 + F.col("offset_px")).alias("x_raw"),
        F.lit(None).cast("double").alias("x_start"), F.lit(None).cast("double").alias("x_smooth"),
        F.when(t % 5 != 0, F.col("ref_x")).alias("ref_x"), F.when(t % 4 != 0, F.col("y_center")).alias("y_center"),
    )
    sizes = views.datasets(spark, sf).withColumns(
        {"image_w": F.coalesce("image_w", F.lit(640.0)), "image_h": F.coalesce("image_h", F.lit(480.0))}
    )
    return P.viewer_positions(drawn, sizes)


@query("e22_reconcile_edits", sql("v_items", """
WITH i AS (SELECT * FROM v_items WHERE tube_idx % 9 <> 0), e AS (SELECT * FROM v_items WHERE tube_idx % 7 <> 0)
SELECT i.run_id, i.side, i.id, CASE WHEN e.id IS NULL THEN i.active ELSE NOT e.active END AS active, coalesce(e.unmatched, i.unmatched) AS unmatched,
       CASE WHEN e.tube_idx % 2 = 0 THEN 'moved' ELSE i.notes END AS notes,
       CASE WHEN i.side = '152' THEN CASE WHEN e.tube_idx % 3 = 0 THEN 'after' ELSE coalesce(i.relative_position, 'after') END END AS relative_position,
       CASE WHEN e.id IS NULL THEN 'missing' WHEN e.tube_idx % 5 = 0 THEN 'repeated' END AS error
FROM i LEFT JOIN e ON e.id = i.id AND e.run_id = i.run_id AND e.side = i.side
UNION ALL SELECT run_id, side, id, NOT active, unmatched, CASE WHEN tube_idx % 2 = 0 THEN 'moved' ELSE '' END, CASE WHEN side = '152' THEN 'after' END, 'unknown' FROM e WHERE tube_idx % 9 = 0"""))
def reconcile_edits(spark, sf):
    every = views.items(spark, sf)
    t = F.col("tube_idx")
    known = every.filter(t % 9 != 0).select("run_id", "side", "id", "active", "unmatched", "notes", "relative_position")
    once = every.filter(t % 7 != 0).select(
        "run_id", "side", "id", (~F.col("active")).alias("active"), "unmatched",
        F.when(t % 2 == 0, " moved ").otherwise("").alias("notes"), F.when(t % 3 == 0, "AFTER").otherwise("").alias("relative_position"), "tube_idx",
    )
    edits = once.unionByName(once.filter(t % 5 == 0)).drop("tube_idx")
    return P.reconcile_edits(known, edits)


@query("e16_manual_compare", sql("v_items v_ref", """
WITH a AS (SELECT run_id, side, tube_idx AS tube_number, distance_in, relative_position, y_center, offset_px FROM v_items),
p AS (SELECT run_id, tube_number, max(CASE WHEN side = '151' THEN 612.0 + offset_px END) AS x1, max(CASE WHEN side = '151' THEN y_center END) AS y1,
             max(CASE WHEN side = '152' THEN 608.0 + offset_px END) AS x2, max(CASE WHEN side = '152' THEN y_center END) AS y2 FROM a GROUP BY 1, 2),
r AS (SELECT *, 605.0::DOUBLE + (y1 - 0.0) / 1500.0 * 10.0 AS ref1, 612.0::DOUBLE + (y2 - 0.0) / 1500.0 * -4.0 AS ref2 FROM p),
m AS (SELECT *, abs(x1 - ref1) / 5.0 AS manual_151, abs(x2 - ref2) / 5.0 AS manual_152, CASE WHEN x2 < ref2 THEN 'before' WHEN x2 IS NOT NULL THEN 'after' END AS manual_position_152 FROM r),
j AS (SELECT m.*, l.distance_in AS a1, b.distance_in AS a2, b.relative_position AS pos FROM m
      LEFT JOIN a l ON l.run_id = m.run_id AND l.tube_number = m.tube_number AND l.side = '151'
      LEFT JOIN a b ON b.run_id = m.run_id AND b.tube_number = m.tube_number AND b.side = '152'),
t AS (SELECT *, 408.5 + (manual_151 - 47.75) + CASE WHEN manual_position_152 = 'before' THEN 41.0 - manual_152 ELSE 41.0 + manual_152 END AS mt,
                408.5 + (a1 - 47.75) + CASE WHEN pos = 'before' THEN 41.0 - a2 ELSE 41.0 + a2 END AS "at" FROM j)
SELECT run_id, tube_number, CASE WHEN x1 IS NOT NULL AND x2 IS NOT NULL THEN 'complete' ELSE 'partial' END AS status,
       round(manual_151, 6) AS manual_151, round(a1, 6) AS algorithm_151, round(manual_151 - a1, 6) AS delta_151, round(manual_152, 6) AS manual_152,
       round(a2, 6) AS algorithm_152, round(manual_152 - a2, 6) AS delta_152, manual_position_152, round(mt, 6) AS manual_total,
       round("at", 6) AS algorithm_total, round(mt - "at", 6) AS delta_total FROM t"""))
def manual_compare(spark, sf):
    every = views.items(spark, sf)
    pick = lambda side, value: F.max(F.when(F.col("side") == side, value))
    points = every.groupBy("run_id", F.col("tube_idx").alias("tube_number")).agg(
        pick("151", 612.0 + F.col("offset_px")).alias("x_151"), pick("151", F.col("y_center")).alias("y_151"),
        pick("152", 608.0 + F.col("offset_px")).alias("x_152"), pick("152", F.col("y_center")).alias("y_152"),
    )
    lines = {r["side"]: r for r in reference_table(spark).collect()}  # two fixed rows
    sides = every.select("run_id").distinct().select(
        "run_id",
        *[F.lit(lines[s][c]).alias(f"{c}_{s}") for s in ("151", "152") for c in ("lx0", "ly0", "lx1", "ly1", "const_x", "px_per_in")],
    )
    compared = P.manual_compare(points, sides, every)
    numbers = [c for c, kind in compared.dtypes if kind == "double"]
    return compared.withColumns({c: r6(c) for c in numbers})


@query("length_table", sql("v_boxes v_ref", f"""
WITH kept AS (SELECT run_id, side, unnest(kept) AS b FROM {q_boxes.strong('v_boxes')}),
m AS (SELECT run_id, side, row_number() OVER (PARTITION BY run_id, side ORDER BY b.yc, b.box_id) AS k,
             b.xc - (lx0 + (b.yc - 0.0::DOUBLE) / 1500.0::DOUBLE * (lx1 - lx0)) AS off FROM kept JOIN v_ref USING (side)),
p AS (SELECT coalesce(l.run_id, r.run_id) AS run_id, CAST(coalesce(l.k, r.k) AS INTEGER) AS tube_number,
             CASE WHEN l.k IS NOT NULL AND r.k IS NOT NULL THEN 'matched' WHEN l.k IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS match_status,
             408.5::DOUBLE + (abs(l.off) / 5.0::DOUBLE - 47.75::DOUBLE) + CASE WHEN r.off < 0 THEN 41.0::DOUBLE + abs(r.off) / 5.0::DOUBLE ELSE 41.0::DOUBLE - abs(r.off) / 5.0::DOUBLE END AS total
      FROM (SELECT * FROM m WHERE side = '151') l FULL JOIN (SELECT * FROM m WHERE side = '152') r ON l.run_id = r.run_id AND l.k = r.k)
SELECT run_id, tube_number, match_status, round(total, 6) AS length_in,
       CASE WHEN match_status <> 'matched' THEN 'X' WHEN total >= 493 THEN 'A' WHEN total >= 491 THEN 'B' ELSE 'C' END AS length_group FROM p"""))
def length_table(spark, sf):
    """Boxes, overlap suppression, numbers, offsets, order match, lengths."""
    packed = B.pack(views.boxes(spark, sf).repartition("run_id"))
    kept = B.unpack(packed.withColumn("boxes", B.suppress_overlaps(B.drop_tiny(F.col("boxes")))))
    measured = M.measure_offsets(B.number_boxes(kept), F.broadcast(reference_table(spark)))  # two rows: one per side
    items = measured.select(
        "run_id", "side", F.col("box_id").alias("id"), "tube_idx", "distance_in", "relative_position", F.lit("").alias("notes"),
        F.lit(False).alias("unmatched"), F.lit(True).alias("active"), F.col("yc").alias("y_center"), F.col("tube_idx").alias("source_order"),
    )
    rows = P.order_match(P.active_order(items))
    return M.display_rows(M.match_values(rows)).select(
        "run_id", "tube_number", "match_status", r6("length_in").alias("length_in"), "length_group"
    )
