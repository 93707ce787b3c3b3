"""Queries on boxes: geometry, suppression, spacing, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import boxes as G
from gaugeline.operators import boxes as B
from gaugeline.plans import views
from gaugeline.plans.registry import mid, query, r6, sorted_list
from gaugeline.plans.views import sql

# DuckDB text ---------------------------------------------------------------------------

AREA = "(greatest(0.0, {0}x2 - {0}x1) * greatest(0.0, {0}y2 - {0}y1))"
INTER = (
    "(greatest(0.0, least({0}x2, {1}x2) - greatest({0}x1, {1}x1))"
    " * greatest(0.0, least({0}y2, {1}y2) - greatest({0}y1, {1}y1)))"
)


def area(a: str) -> str:
    return AREA.format(a)


def inter(a: str, b: str) -> str:
    return INTER.format(a, b)


def over(a: str, b: str) -> str:
    least = f"least({area(a)}, {area(b)})"
    return f"(CASE WHEN {least} <= 1e-6 THEN 0.0 ELSE {inter(a, b)} / {least} END)"


def vertical(a: str, b: str) -> str:
    least = f"least({a}h, {b}h)"
    shared = f"greatest(0.0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    return f"(CASE WHEN {least} <= 1e-6 THEN 0.0 ELSE {shared} / {least} END)"


BOX = (
    "{'yc': yc, 'box_id': box_id, 'xc': xc, 'w': w, 'h': h, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2,"
    " 'conf': conf, 'flags': []::VARCHAR[], 'solo': 0}"
)
STRONGEST_FIRST = f"conf DESC, {area('')}, yc, box_id"

SINGLE = f"""single AS (
  SELECT * FROM v_boxes b WHERE {area('b.')} > 1 AND (
    SELECT count(*) FROM v_boxes o WHERE o.img = b.img AND {area('o.')} > 1 AND {area('b.')} > {area('o.')}
      AND {inter('b.', 'o.')} / {area('o.')} >= 0.85) < 2)"""


def strong(source: str) -> str:
    """Fold of the overlap suppression over one array per image: rows (keys, kept)."""
    return f"""(SELECT run_id, side, img, list_reduce(list_transform(a, lambda b: [b]), lambda acc, b:
      CASE WHEN len(list_filter(acc, lambda k: {over('k.', 'b[1].')} > 0.45)) > 0 THEN acc
           ELSE list_concat(acc, b) END) AS kept
      FROM (SELECT run_id, side, img, list({BOX} ORDER BY {STRONGEST_FIRST}) AS a
            FROM {source} WHERE {area('')} > 1 GROUP BY ALL))"""


def collapsed(source: str) -> str:
    """Fold of the vertical merge over one sorted array per image ``a``."""
    last, new = "acc[len(acc)].", "b[1]."
    local = (
        f"((abs({new}yc - {last}yc) < 0.5 * greatest({new}h, {last}h) OR {over(new, last)} >= 0.3)"
        f" AND abs({new}xc - {last}xc) <= 1.25 * greatest({new}w, {last}w))"
    )
    band = f"({vertical(new, last)} >= 0.65)"
    flag = f"CASE WHEN {band} THEN 'kept_vertical_y_duplicate' ELSE 'kept_vertical_duplicate' END"

    def flagged(b: str) -> str:
        fields = ", ".join(f"'{n}': {b}{n}" for n in ("yc", "box_id", "xc", "w", "h", "x1", "y1", "x2", "y2", "conf"))
        # solo: how often the box won because of the band alone
        return f"{{{fields}, 'flags': list_append({b}flags, {flag}), 'solo': {last}solo + CASE WHEN {band} AND NOT {local} THEN 1 ELSE 0 END}}"

    return f"""(SELECT run_id, side, img, list_reduce(list_transform(a, lambda b: [b]), lambda acc, b:
      CASE WHEN {local} OR {band}
           THEN list_concat(acc[1:len(acc) - 1], [CASE WHEN {new}conf > {last}conf THEN {flagged(new)} ELSE {flagged(last)} END])
           ELSE list_concat(acc, b) END) AS kept
      FROM {source})"""


CHAIN = f"""WITH {SINGLE},
strong AS {strong('single')},
final AS {collapsed('(SELECT run_id, side, img, list_sort(kept) AS a FROM strong)')}"""


# Queries -------------------------------------------------------------------------------


def packed(spark, sf):
    return B.pack(views.boxes(spark, sf))


@query("b4_box_geometry", sql("v_boxes", f"""
SELECT img, box_id, round({area('a.')}, 6) AS area, round({inter('a.', 'b.')}, 6) AS shared,
       round({over('a.', 'b.')}, 6) AS overlap, {vertical('a.', 'b.')} AS vertical_overlap
FROM (SELECT img, box_id, a, lead(a) OVER (PARTITION BY img ORDER BY a.yc, box_id) AS b
      FROM (SELECT img, box_id, {BOX} AS a FROM v_boxes)) WHERE b IS NOT NULL"""))
def box_geometry(spark, sf):
    rows = views.boxes(spark, sf).withColumn("a", F.struct(*B.FIELDS))
    pairs = rows.withColumn("b", F.lead("a").over(B.top_down())).filter(F.col("b").isNotNull())
    a, b = F.col("a"), F.col("b")
    return pairs.select(
        "img", "box_id", r6(G.area(a)).alias("area"), r6(G.intersection(a, b)).alias("shared"),
        r6(G.overlap_over_smaller(a, b)).alias("overlap"),
        G.vertical_overlap_over_smaller(a, b).alias("vertical_overlap"),  # as it is: quotients of few digits are often ties of a rounding
    )


@query("b5_box_from_corners", sql("v_boxes", """
SELECT img, box_id, round(greatest(0.0, x2 - x1), 6) AS w, round(greatest(0.0, y1 - y2), 6) AS h,
       round(x1 + 0.5 * greatest(0.0, x2 - x1), 6) AS xc, round(y2 + 0.5 * greatest(0.0, y1 - y2), 6) AS yc
FROM v_boxes"""))
def box_from_corners(spark, sf):
    corners = views.boxes(spark, sf).select("img", "box_id", "x1", F.col("y2").alias("y1"), "x2", F.col("y1").alias("y2"))
    return G.from_corners(corners).select("img", "box_id", *[r6(c).alias(c) for c in ("w", "h", "xc", "yc")])


@query("e4_container_boxes", sql("v_boxes", f"WITH {SINGLE} SELECT img, box_id, conf FROM single"))
def container_boxes(spark, sf):
    kept = packed(spark, sf).withColumn("boxes", B.drop_containers(B.drop_tiny(F.col("boxes"))))
    return B.unpack(kept).select("img", "box_id", "conf")


@query("e5_suppress_overlaps", sql("v_boxes", f"""
SELECT img, b.box_id AS box_id, b.conf AS conf FROM (SELECT img, unnest(kept) AS b FROM {strong('v_boxes')})"""))
def suppress_overlaps(spark, sf):
    kept = packed(spark, sf).withColumn("boxes", B.suppress_overlaps(B.drop_tiny(F.col("boxes"))))
    return B.unpack(kept).select("img", "box_id", "conf")


@query("e6_collapse_vertical_duplicates", sql("v_boxes", f"""
WITH arranged AS (SELECT run_id, side, img, list({BOX} ORDER BY yc, box_id) AS a FROM v_boxes GROUP BY ALL)
SELECT img, b.box_id AS box_id, b.conf AS conf, array_to_string(b.flags, '|') AS flags
FROM (SELECT img, unnest(kept) AS b FROM {collapsed('arranged')})"""))
def collapse_vertical_duplicates(spark, sf):
    kept = packed(spark, sf).withColumn("boxes", B.collapse_vertical(F.col("boxes")))
    return B.unpack(kept).select("img", "box_id", "conf", F.array_join("flags", "|").alias("flags"))


@query("c14_suppression_audit", sql("v_boxes", f"""{CHAIN}
SELECT r.img, r.n AS raw_count, v.n AS valid_count, v.n - s.n AS removed_large_containers,
       s.n - len(strong.kept) AS suppressed_overlap, len(strong.kept) - len(final.kept) AS suppressed_vertical_duplicate,
       CAST(list_sum(list_transform(final.kept, lambda k: k.solo)) AS BIGINT) AS suppressed_vertical_y_duplicate, len(final.kept) AS final_count
FROM (SELECT img, count(*) AS n FROM v_boxes GROUP BY 1) r
JOIN (SELECT img, count(*) AS n FROM v_boxes WHERE {area('')} > 1 GROUP BY 1) v USING (img)
JOIN (SELECT img, count(*) AS n FROM single GROUP BY 1) s USING (img) JOIN strong USING (img) JOIN final USING (img)"""))
def suppression_audit(spark, sf):
    return B.suppression_audit(packed(spark, sf)).drop("run_id", "side")


@query("d1_gaps", sql("v_gaps", "SELECT img, box_id, round(gap, 6) AS gap FROM v_gaps"))
def gaps(spark, sf):
    return B.gaps(views.boxes(spark, sf)).select("img", "box_id", r6("gap").alias("gap"))


def pitch_text(low: float, high: float, floor: str) -> str:
    return f"""
WITH raw AS (SELECT img, count(*) AS n, {sorted_list('gap', 'gap > 1e-6')} AS g, {sorted_list('h', 'h > 1e-6')} AS hs
             FROM v_gaps GROUP BY 1),
central AS (SELECT img, {sorted_list('gap', f'gap > 1e-6 AND gap BETWEEN {low} * {mid("g")} AND {high} * {mid("g")}')} AS c
            FROM v_gaps JOIN raw USING (img) GROUP BY 1)
SELECT img, n, round(CASE WHEN n >= 2 THEN {floor} END, 6) AS pitch FROM raw JOIN central USING (img)"""


PITCH = f"coalesce({mid('c')}, {mid('g')})"


@query("d2_robust_pitch", sql("v_gaps", pitch_text(
    0.45, 1.75, f"CASE WHEN {mid('g')} IS NULL THEN 1.15 * {mid('hs')} ELSE greatest({PITCH}, 1.1 * {mid('hs')}) END")))
def robust_pitch(spark, sf):
    return B.robust_pitch(views.boxes(spark, sf)).select("img", "n", r6("pitch").alias("pitch"))


@query("d2_vertical_pitch", sql("v_gaps", pitch_text(0.45, 1.85, PITCH)))
def vertical_pitch(spark, sf):
    return B.robust_pitch(views.boxes(spark, sf), 0.45, 1.85, None).select("img", "n", r6("pitch").alias("pitch"))


@query("d3_isolated_clusters", sql("v_boxes", f"""
WITH g AS (SELECT *, yc - lag(yc) OVER w AS gap, count(*) OVER (PARTITION BY img) AS n,
                  list(h) OVER (PARTITION BY img) AS hs
           FROM v_boxes WINDOW w AS (PARTITION BY img ORDER BY yc, box_id)),
t AS (SELECT *, {mid('list_sort(hs)')} AS tall FROM g),
p AS (SELECT *, list_sort(list(gap) FILTER (WHERE gap > 1e-6 AND gap <= greatest(55.0, 4.0 * tall)) OVER (PARTITION BY img)) AS near,
                list_sort(list(gap) FILTER (WHERE gap > 1e-6) OVER (PARTITION BY img)) AS every FROM t),
k AS (SELECT *, greatest(55.0, 2.8 * coalesce({mid('near')}, {mid('every')}, 1.4 * tall), 3.5 * tall) AS cut FROM p),
c AS (SELECT *, sum(CASE WHEN gap > cut THEN 1 ELSE 0 END) OVER (PARTITION BY img ORDER BY yc, box_id) AS cluster FROM k),
s AS (SELECT *, count(*) OVER (PARTITION BY img, cluster) AS size FROM c),
m AS (SELECT *, max(size) OVER (PARTITION BY img) AS most,
             min(cluster) FILTER (WHERE size = biggest) OVER (PARTITION BY img) AS first_most
      FROM (SELECT *, max(size) OVER (PARTITION BY img) AS biggest FROM s))
SELECT img, box_id FROM m WHERE n < 4 OR size >= 3 OR (most < 3 AND cluster = first_most)"""))
def isolated_clusters(spark, sf):
    return B.isolated_clusters(views.boxes(spark, sf)).select("img", "box_id")


LATERAL = f"""
WITH n AS (SELECT *, lag(yc) OVER w AS uy, lag(xc) OVER w AS ux, lead(yc) OVER w AS ly, lead(xc) OVER w AS lx,
                  list_sort(list(w) OVER (PARTITION BY img)) AS ws
           FROM v_boxes WINDOW w AS (PARTITION BY img ORDER BY yc, box_id)),
f AS (SELECT *, coalesce(abs(ly - uy) > 1e-6 AND abs(xc - (ux + greatest(0.0, least(1.0, (yc - uy) / nullif(ly - uy, 0)))
               * (lx - ux))) > greatest(35.0, 1.8 * {mid('ws')}), false) AS far FROM n),
v AS (SELECT img, box_id, yc, CASE WHEN NOT far THEN 'kept' WHEN conf >= 0.47 THEN 'kept_far' ELSE 'removed' END AS verdict FROM f)
"""


@query("d4_lateral_outliers", sql("v_boxes", LATERAL + """
SELECT img, box_id, verdict, CASE WHEN verdict = 'kept_far' THEN 'kept_far_x_high_conf' ELSE '' END AS flags FROM v"""))
def lateral_outliers(spark, sf):
    return B.lateral_outliers(views.boxes(spark, sf)).select("img", "box_id", "verdict", F.array_join("flags", "|").alias("flags"))


@query("f7_removed_sample", sql("v_boxes", LATERAL + """
SELECT img, count(*) AS removed_count, array_to_string(list(box_id ORDER BY yc, box_id)[1:12], ',') AS removed
FROM v WHERE verdict = 'removed' GROUP BY 1"""))
def removed_sample(spark, sf):
    return B.removed_sample(views.boxes(spark, sf)).drop("run_id", "side")


@query("d5_number_boxes", sql("v_boxes", """
SELECT img, box_id, CAST(row_number() OVER w AS INTEGER) AS tube_idx,
       CAST(count(*) OVER (PARTITION BY img) - row_number() OVER w + 1 AS INTEGER) AS from_bottom
FROM v_boxes WINDOW w AS (PARTITION BY img ORDER BY yc, box_id)"""))
def number_boxes(spark, sf):
    return B.number_boxes(views.boxes(spark, sf)).select("img", "box_id", "tube_idx", "from_bottom")


OVERSIZE = f"""
WITH n AS (SELECT *, lag(h) OVER w AS up, lead(h) OVER w AS low, lead(xc) OVER w - xc AS dx, count(*) OVER (PARTITION BY img) AS n,
                  list_sort(list(h) OVER (PARTITION BY img)) AS hs, list_sort(list(w) OVER (PARTITION BY img)) AS ws
           FROM v_boxes WINDOW w AS (PARTITION BY img ORDER BY yc, box_id)),
d AS (SELECT *, {mid('hs')} AS median_h, greatest(10.0, 1.1 * greatest({mid('ws')}, 1.0)) AS near FROM n),
o AS (SELECT *, CASE WHEN n < 2 OR h < 1.65 * coalesce(0.5 * (up + low), up, low, median_h) THEN 'normal'
                     WHEN dx < -near THEN 'skipped_far_left' WHEN abs(dx) > near THEN 'skipped_far_x' ELSE 'candidate' END AS decision
      FROM d)"""


@query("d6_oversize_boxes", sql("v_boxes", OVERSIZE + """
SELECT img, box_id, decision, CASE WHEN decision = 'candidate'
       THEN least(greatest(2, CAST(round_even(h / median_h, 0) AS INTEGER)), 4) END AS parts FROM o"""))
def oversize_boxes(spark, sf):
    return B.oversize_boxes(views.boxes(spark, sf)).select("img", "box_id", "decision", "parts")


@query("f3_largest_box", sql("v_boxes", f"""
SELECT img, box_id FROM (SELECT img, box_id, row_number() OVER (PARTITION BY img ORDER BY {area('')} DESC, yc, box_id DESC) AS k
FROM v_boxes) WHERE k = 1"""))
def largest_box(spark, sf):
    return B.largest_box(views.boxes(spark, sf)).select("img", "box_id")


@query("f4_top_boxes", sql("v_boxes", """
SELECT img, box_id, CAST(place AS INTEGER) AS place FROM (
  SELECT img, box_id, row_number() OVER (PARTITION BY img ORDER BY conf DESC, yc, box_id) AS place FROM v_boxes) WHERE place <= 5"""))
def top_boxes(spark, sf):
    return B.top_boxes(views.boxes(spark, sf), 5).select("img", "box_id", "place")


@query("g3_distinct_images", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_partkey % 2) AS cameras FROM lineitem")
def distinct_images(spark, sf):
    parts = views.table(spark, sf, "lineitem").select("l_partkey").distinct()
    return parts.agg(F.count(F.lit(1)).alias("parts"), F.countDistinct(F.col("l_partkey") % 2).alias("cameras"))
