"""Calibration geometry: quads, homographies, projections, scales.

A calibration is one small file: its points and lines are few.  Tables of calibrations
may be long and are joined to facts by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline import constants as K
from gaugeline.session import cut_lineage

CORNERS = ["tlx", "tly", "trx", "try", "blx", "bly", "brx", "bry"]
MATRIX = ["h11", "h12", "h13", "h21", "h22", "h23", "h31", "h32", "h33"]


def c(name: str) -> str:
    return f"`{name}`"


def unit_square_to_quad(df: DataFrame, tl: str, tr: str, bl: str, br: str, out: str) -> DataFrame:
    """Adds a struct of the nine terms that map the unit square to a quad; null if degenerate."""
    x0, y0, x1, y1, x2, y2, x3, y3 = (c(p + a) for p in (tl, tr, bl, br) for a in ("x", "y"))
    df = df.withColumn(
        "_s",
        F.expr(
            f"struct({x1} - {x3} AS dx1, {x2} - {x3} AS dx2, {x0} - {x1} - {x2} + {x3} AS sx, "
            f"{y1} - {y3} AS dy1, {y2} - {y3} AS dy2, {y0} - {y1} - {y2} + {y3} AS sy)"
        ),
    )
    den = "nullif(_s.dx1 * _s.dy2 - _s.dx2 * _s.dy1, 0D)"
    df = df.withColumn("_g", F.expr(f"(_s.sx * _s.dy2 - _s.dx2 * _s.sy) / {den}")).withColumn("_h", F.expr(f"(_s.dx1 * _s.sy - _s.sx * _s.dy1) / {den}"))
    terms = (
        f"struct({x1} - {x0} + _g * {x1} AS a, {x2} - {x0} + _h * {x2} AS b, {x0} AS c, "
        f"{y1} - {y0} + _g * {y1} AS d, {y2} - {y0} + _h * {y2} AS e, {y0} AS f, _g AS g, _h AS h)"
    )
    return df.withColumn(out, F.expr(f"CASE WHEN _g IS NOT NULL AND _h IS NOT NULL THEN {terms} END")).drop("_s", "_g", "_h")


def quad_to_rect(df: DataFrame, unit: str, width: str, height: str) -> DataFrame:
    """Adds h11..h33: the map from a quad to a rectangle of the given size."""
    m = lambda t: f"{unit}.{t}"
    inverse = {
        "i11": f"{m('e')} - {m('f')} * {m('h')}", "i12": f"{m('c')} * {m('h')} - {m('b')}", "i13": f"{m('b')} * {m('f')} - {m('c')} * {m('e')}",
        "i21": f"{m('f')} * {m('g')} - {m('d')}", "i22": f"{m('a')} - {m('c')} * {m('g')}", "i23": f"{m('c')} * {m('d')} - {m('a')} * {m('f')}",
        "i31": f"{m('d')} * {m('h')} - {m('e')} * {m('g')}", "i32": f"{m('b')} * {m('g')} - {m('a')} * {m('h')}", "i33": f"{m('a')} * {m('e')} - {m('b')} * {m('d')}",
    }
    df = df.withColumn("_i", F.struct(*[F.expr(text).alias(name) for name, text in inverse.items()]))
    scale = {"1": f"({width} - 1)", "2": f"({height} - 1)", "3": "1D"}
    return df.withColumns(
        {f"h{r}{k}": F.expr(f"{scale[str(r)]} * _i.i{r}{k} / nullif(_i.i33, 0D)") for r in (1, 2, 3) for k in (1, 2, 3)}
    ).drop("_i")


def fit_homography(quads: DataFrame) -> DataFrame:
    """Homography and output size of source quads.

    Rows hold tlx..bry, an optional destination rectangle rx0..ry1, ``exact`` (no default
    padding) and ``mirror`` (flip the output).  A quad with a side under 40 pixels, before or
    after it is widened to the destination rectangle, carries an error and no matrix.
    """
    length = lambda a, b: f"sqrt(({a}x - {b}x) * ({a}x - {b}x) + ({a}y - {b}y) * ({a}y - {b}y))"
    rows = quads.withColumns({"_top": F.expr(length("tl", "tr")), "_low": F.expr(length("bl", "br")), "_left": F.expr(length("tl", "bl")), "_right": F.expr(length("tr", "br"))})
    rows = rows.withColumns(
        {"error": F.expr("CASE WHEN least(_top, _low, _left, _right) < 40 THEN 'degenerate' END"),
         "base_w": F.expr("greatest(240D, rint(greatest(_top, _low)))"), "base_h": F.expr("greatest(320D, rint(greatest(_left, _right)))")}
    )
    rows = rows.withColumns(
        {
            "rx0": F.expr("coalesce(rx0, CASE WHEN exact THEN 0D ELSE -greatest(24D, rint(0.06D * base_w)) END)"),
            "ry0": F.expr("coalesce(ry0, CASE WHEN exact THEN 0D ELSE -rint(0.01D * base_h) END)"),
            "rx1": F.expr("coalesce(rx1, CASE WHEN exact THEN base_w - 1 ELSE base_w - 1 + greatest(140D, rint(0.55D * base_w)) END)"),
            "ry1": F.expr("coalesce(ry1, CASE WHEN exact THEN base_h - 1 ELSE base_h - 1 + rint(0.01D * base_h) END)"),
        }
    )
    rows = unit_square_to_quad(rows, "tl", "tr", "bl", "br", "_m")
    corner = {}
    for name, x, y in (("_tl", "rx0", "ry0"), ("_tr", "rx1", "ry0"), ("_bl", "rx0", "ry1"), ("_br", "rx1", "ry1")):
        u, v = f"({x} / (base_w - 1))", f"({y} / (base_h - 1))"
        depth = f"nullif(_m.g * {u} + _m.h * {v} + 1D, 0D)"
        corner[name + "x"] = F.expr(f"(_m.a * {u} + _m.b * {v} + _m.c) / {depth}")
        corner[name + "y"] = F.expr(f"(_m.d * {u} + _m.e * {v} + _m.f) / {depth}")
    rows = rows.withColumns(corner)
    sides = [length("_tl", "_tr"), length("_bl", "_br"), length("_tl", "_bl"), length("_tr", "_br")]
    rows = rows.withColumn("error", F.expr(f"coalesce(error, CASE WHEN least({', '.join(sides)}) < 40 THEN 'degenerate' END)"))
    rows = rows.withColumns({"out_w": F.expr("greatest(80D, rint(rx1 - rx0))"), "out_h": F.expr("greatest(80D, rint(ry1 - ry0))")})
    rows = quad_to_rect(unit_square_to_quad(rows, "_tl", "_tr", "_bl", "_br", "_n"), "_n", "out_w", "out_h")
    flipped = {f"h1{k}": F.expr(f"CASE WHEN mirror THEN (out_w - 1) * h3{k} - h1{k} ELSE h1{k} END") for k in (1, 2, 3)}
    rows = rows.withColumns(flipped).withColumns({h: F.when(F.col("error").isNull(), F.col(h)) for h in MATRIX})
    return rows.drop("_top", "_low", "_left", "_right", "_m", "_n", *corner)


def invert_matrix(df: DataFrame) -> DataFrame:
    """Adds g11..g33, the inverse of h11..h33 up to scale."""
    h = lambda r, k: f"h{r}{k}"
    minor = lambda a, b, d, e: f"({a} * {b} - {d} * {e})"
    terms = {}
    for r in (1, 2, 3):
        for k in (1, 2, 3):
            rows = [i for i in (1, 2, 3) if i != k]
            cols = [i for i in (1, 2, 3) if i != r]
            value = minor(h(rows[0], cols[0]), h(rows[1], cols[1]), h(rows[0], cols[1]), h(rows[1], cols[0]))
            terms[f"g{r}{k}"] = F.expr(value if (r + k) % 2 == 0 else f"-{value}")
    return df.withColumns(terms)


def project(x: str, y: str, matrix: str = "h") -> tuple:
    """Columns of a projected point; null when the point has no finite image."""
    depth = f"nullif({matrix}31 * {x} + {matrix}32 * {y} + {matrix}33, 0D)"
    return (
        F.expr(f"({matrix}11 * {x} + {matrix}12 * {y} + {matrix}13) / {depth}"), F.expr(f"({matrix}21 * {x} + {matrix}22 * {y} + {matrix}23) / {depth}")
    )


def project_points(points: DataFrame, homographies: DataFrame, key: str, clamp_to: tuple | None = None) -> DataFrame:
    """Points (key, x, y) in warped coordinates px, py; optionally clamped to an image."""
    px, py = project("x", "y")
    rows = points.join(homographies.select(key, *MATRIX), key).withColumns({"px": px, "py": py})
    if clamp_to is not None:
        w, h = clamp_to
        rows = rows.withColumns({"px": F.expr(f"greatest(0D, least({w - 1}D, px))"), "py": F.expr(f"greatest(0D, least({h - 1}D, py))")})
    return rows.drop(*MATRIX)


def intersect(a: tuple, b: tuple) -> tuple[str, str]:
    """Expression texts of the intersection of two lines given as (x1, y1, x2, y2)."""
    a1, b1, c1 = f"({a[1]} - {a[3]})", f"({a[2]} - {a[0]})", f"({a[0]} * {a[3]} - {a[2]} * {a[1]})"
    a2, b2, c2 = f"({b[1]} - {b[3]})", f"({b[2]} - {b[0]})", f"({b[0]} * {b[3]} - {b[2]} * {b[1]})"
    det = f"({a1} * {b2} - {a2} * {b1})"
    usable = f"(CASE WHEN abs({det}) >= 1e-8D THEN {det} END)"
    return f"(({b1} * {c2} - {b2} * {c1}) / {usable})", f"(({c1} * {a2} - {c2} * {a1}) / {usable})"


def label_key(column: str) -> str:
    return f"regexp_replace(lower(trim({column})), '[[:space:]]+', ' ')".replace("[[:space:]]", r"\\s")


def labelled_points(points: DataFrame, labels: list[str]) -> DataFrame:
    """One row per calibration with <label>_x and <label>_y; the first point of a label counts."""
    key = F.expr(label_key("label"))
    picks = []
    for label in labels:
        first = F.min_by(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), F.when(key == label, F.col("position")))
        present = F.count_if(key == label) > 0
        picks += [F.when(present, first)["x"].alias(f"{label}_x"), F.when(present, first)["y"].alias(f"{label}_y")]
    return points.groupBy("cal_id").agg(*picks)


def ordered_line(prefix: str = "") -> str:
    """End points of a line from left to right, as a struct of doubles."""
    x1, y1, x2, y2 = (f"cast({prefix}{n} AS double)" for n in ("x1", "y1", "x2", "y2"))
    return f"CASE WHEN {x1} <= {x2} THEN struct({x1} AS x1, {y1} AS y1, {x2} AS x2, {y2} AS y2) ELSE struct({x2} AS x1, {y2} AS y1, {x1} AS x2, {y1} AS y2) END"


def line_table(lines: DataFrame) -> DataFrame:
    """Per calibration: top and bottom guides by label, outer horizontals, verticals in order."""
    rows = lines.withColumns({"_k": F.expr(label_key("label")), "_l": F.expr(ordered_line()), "_ay": F.expr("(y1 + y2) / 2D"), "_ax": F.expr("(x1 + x2) / 2D")})
    pick = lambda test: f"min_by(_l, position) FILTER (WHERE {test})"
    bottom = "_k IN ('bottom_horrizontal', 'bottom_horizontal')"
    flat = "kind = 'horizontal_ref'"
    return rows.groupBy("cal_id").agg(
        F.expr(pick("_k = 'top_ref'")).alias("top_ref"), F.expr(pick(bottom)).alias("bottom_ref"),
        F.expr(f"min_by(_l, struct(_ay, position)) FILTER (WHERE {flat})").alias("first_flat"),
        F.expr(f"max_by(_l, struct(_ay, position)) FILTER (WHERE {flat})").alias("last_flat"), F.expr(f"count_if({flat})").alias("n_flat"),
        F.expr("transform(array_sort(collect_list(CASE WHEN kind = 'vertical_ref' THEN struct(_ax, position, _l AS l) END)), v -> v.l)").alias("verticals"),
    )


def x_at(line: str, y: str) -> str:
    steep = f"(CASE WHEN abs({line}.y2 - {line}.y1) >= 1e-8D THEN {line}.y2 - {line}.y1 END)"
    return f"coalesce({line}.x1 + ({y} - {line}.y1) / {steep} * ({line}.x2 - {line}.x1), 0.5D * ({line}.x1 + {line}.x2))"


def nearest_guides(df: DataFrame) -> DataFrame:
    """Vertical lines nearest to the left and to the right seed, swapped if they cross.

    Rows hold verticals, left_seed, right_seed (lines) and y_probe; adds left_guide and
    right_guide, null with fewer than two verticals.
    """
    placed = f"transform(verticals, (l, i) -> struct({x_at('l', 'y_probe')} AS x, i AS i, l AS l))"
    rows = df.withColumns({"_p": F.expr(placed), "_ls": F.expr(x_at("left_seed", "y_probe")), "_rs": F.expr(x_at("right_seed", "y_probe"))})
    near = lambda source, seed: f"array_min(transform({source}, p -> struct(abs(p.x - {seed}) AS d, p.i AS i, p AS p))).p"
    rows = rows.withColumn("_a", F.expr(near("_p", "_ls")))
    rows = rows.withColumn("_b", F.expr(near("filter(_p, p -> p.i <> _a.i)", "_rs")))
    both = "size(verticals) >= 2"
    return rows.withColumns(
        {"left_guide": F.expr(f"CASE WHEN {both} THEN CASE WHEN _a.x > _b.x THEN _b.l ELSE _a.l END END"),
         "right_guide": F.expr(f"CASE WHEN {both} THEN CASE WHEN _a.x > _b.x THEN _a.l ELSE _b.l END END")}
    ).drop("_p", "_ls", "_rs", "_a", "_b")


QUAD_LABELS = ["top_01", "top_02", "top_03", "top_04", "mark_01", "mark_02", "mark_05", "mark_06", "base_01", "base_02"]


def source_quad(calibrations: DataFrame, points: DataFrame, lines: DataFrame) -> DataFrame:
    """The four source points of each calibration and the rule that gave them.

    In order: override, corner labels, secondary guides, primary guides, outer horizontals.
    """
    rows = calibrations.select("cal_id", "src_points").join(labelled_points(points, QUAD_LABELS), "cal_id", "left").join(line_table(lines), "cal_id", "left")
    seed = lambda a, b: f"struct({a}_x AS x1, {a}_y AS y1, {b}_x AS x2, {b}_y AS y2)"
    rows = rows.withColumns(
        {"left_seed": F.expr(seed("top_03", "mark_06")), "right_seed": F.expr(seed("top_04", "mark_05")),
         "y_probe": F.expr("0.5D * ((top_ref.y1 + top_ref.y2) / 2D + (bottom_ref.y1 + bottom_ref.y2) / 2D)")}
    )
    rows = nearest_guides(rows).withColumns(
        {"_l": F.expr("coalesce(left_guide, left_seed)"), "_r": F.expr("coalesce(right_guide, right_seed)"),
         "_pl": F.expr(seed("top_01", "mark_01")), "_pr": F.expr(seed("top_02", "mark_02"))}
    )
    ends = lambda name: tuple(f"{name}.{e}" for e in ("x1", "y1", "x2", "y2"))
    point = lambda xy: f"struct({xy[0]} AS x, {xy[1]} AS y)"
    cross = lambda a, b: point(intersect(ends(a), ends(b)))
    rows = rows.withColumn("_low", F.expr(cross("_pr", "bottom_ref")))
    rows = rows.withColumn(
        "_pr",
        F.expr("CASE WHEN bottom_ref.x2 > _low.x + 2 THEN struct(bottom_ref.x2 AS x1, bottom_ref.y2 AS y1, bottom_ref.x2 + (_pr.x2 - _pr.x1) AS x2, bottom_ref.y2 + (_pr.y2 - _pr.y1) AS y2) ELSE _pr END"),
    )
    has = lambda *labels: " AND ".join(f"{label}_x IS NOT NULL" for label in labels)
    guides = "top_ref IS NOT NULL AND bottom_ref IS NOT NULL"
    named = lambda label: f"struct({label}_x AS x, {label}_y AS y)"
    at = lambda line, end: f"struct({line}.x{end} AS x, {line}.y{end} AS y)"
    choices = [
        ("size(src_points) = 4", "override", "src_points"),
        (has("top_01", "top_02", "base_01", "base_02"), "corners", f"array({named('top_01')}, {named('top_02')}, {named('base_01')}, {named('base_02')})"),
        (f"{has('top_03', 'top_04', 'mark_05', 'mark_06')} AND {guides}", "secondary", f"array({cross('_l', 'top_ref')}, {cross('_r', 'top_ref')}, {cross('_l', 'bottom_ref')}, {cross('_r', 'bottom_ref')})"),
        (f"{has('top_01', 'top_02', 'mark_01', 'mark_02')} AND {guides}", "primary", f"array({cross('_pl', 'top_ref')}, {cross('_pr', 'top_ref')}, {cross('_pl', 'bottom_ref')}, {cross('_pr', 'bottom_ref')})"),
        ("n_flat >= 2", "horizontals", f"array({at('first_flat', 1)}, {at('first_flat', 2)}, {at('last_flat', 1)}, {at('last_flat', 2)})"),
    ]
    rule = "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for test, name, _ in choices) + " ELSE 'none' END"
    quad = "CASE " + " ".join(f"WHEN rule = '{name}' THEN {text}" for _, name, text in choices) + " END"
    rows = rows.withColumn("rule", F.expr(rule)).withColumn("_q", F.expr(quad))
    return rows.select("cal_id", "rule", *[F.expr(f"_q[{i // 2}].{'xy'[i % 2]}").alias(n) for i, n in enumerate(CORNERS)])


def mirror_points(df: DataFrame, width: int, columns: list[str]) -> DataFrame:
    return df.withColumns({n: F.lit(width - 1) - F.col(n) for n in columns})


def mirror_lines(lines: DataFrame, width: int) -> DataFrame:
    """x of source-space lines mirrored; lines already in warp space stay."""
    warp = "(kind = 'warp_scale_ref' OR coordinate_space = 'warp')"
    return lines.withColumns({n: F.expr(f"CASE WHEN {warp} THEN {n} ELSE {width} - 1 - {n} END") for n in ("x1", "x2")})


def mirror_rois(rois: DataFrame, width: int) -> DataFrame:
    return rois.withColumn("xyxy", F.expr(f"array({width} - 1 - xyxy[2], xyxy[1], {width} - 1 - xyxy[0], xyxy[3])"))


def project_corners(df: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """Adds the projected bounds bx0, by0, bx1, by1 of a rectangle (floor and ceil)."""
    corners = [project(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    xs, ys = F.array(*[p[0] for p in corners]), F.array(*[p[1] for p in corners])
    rows = df.withColumns({"_xs": xs, "_ys": ys})
    return rows.withColumns(
        {"bx0": F.expr("cast(floor(array_min(_xs)) AS double)"), "by0": F.expr("cast(floor(array_min(_ys)) AS double)"),
         "bx1": F.expr("cast(ceil(array_max(_xs)) AS double)"), "by1": F.expr("cast(ceil(array_max(_ys)) AS double)")}
    ).drop("_xs", "_ys")


def project_roi(rois: DataFrame) -> DataFrame:
    """Region in the warped image, widened upward, downward and to the right edge."""
    rows = project_corners(rois, "cast(xyxy[0] AS double)", "cast(xyxy[1] AS double)", "cast(xyxy[2] AS double)", "cast(xyxy[3] AS double)")
    rows = rows.withColumn("_h", F.expr("greatest(2D, by1 - by0)"))
    rows = rows.withColumn("wy0", F.expr("greatest(0D, least(by0 - greatest(220D, rint(0.28D * out_h), rint(8D * _h)), out_h - 2))"))
    return rows.withColumns(
        {"wx0": F.expr("greatest(0D, least(bx0 - 18, out_w - 2))"), "wx1": F.col("out_w"),
         "wy1": F.expr("greatest(wy0 + 2, least(by1 + greatest(16D, rint(1.5D * _h)), out_h))")}
    ).drop("_h", "bx0", "by0", "bx1", "by1")


def full_view_rect(homographies: DataFrame, width: int, height: int) -> DataFrame:
    """Bounds of the whole source image in the warped plane, at least 80 wide and high."""
    rows = project_corners(homographies, "0D", "0D", f"{width - 1}D", f"{height - 1}D")
    return rows.withColumns({"view_w": F.expr("greatest(80D, rint(bx1 - bx0))"), "view_h": F.expr("greatest(80D, rint(by1 - by0))")})


def known_distance_pairs(points: DataFrame, homographies: DataFrame) -> DataFrame:
    """Scale samples of labelled point pairs with known inches, one row per pair.

    The pairs lie in front of the left camera: calibrations (``side``) of the other give none.
    """
    homographies = homographies.filter(F.col("side") == "151")
    labels = sorted({label for pair in K.POINT_PAIRS for label in pair[:2]})
    rows = labelled_points(points, labels).join(homographies.select("cal_id", *MATRIX), "cal_id")
    samples = []
    for a, b, inches, name in K.POINT_PAIRS:
        (ax, _), (bx, _) = project(f"{a}_x", f"{a}_y"), project(f"{b}_x", f"{b}_y")
        samples.append(F.struct(F.lit(name).alias("label"), F.lit(inches).alias("distance_in"), F.abs(bx - ax).alias("distance_px")))
    return rows.select("cal_id", F.explode(F.array(*samples)).alias("s")).select("cal_id", "s.*").filter(F.col("distance_px") > 1e-6)


def line_scales(lines: DataFrame, homographies: DataFrame) -> DataFrame:
    """Scale samples of lines with a known length; warp-space lines are taken as they are."""
    warp = (F.col("kind") == "warp_scale_ref") | (F.col("coordinate_space") == "warp")
    rows = lines.filter(F.col("real_distance").isNotNull()).join(homographies.select("cal_id", *MATRIX), "cal_id")
    (ax, _), (bx, _) = project("x1", "y1"), project("x2", "y2")
    width = F.when(warp, F.abs(F.col("x2") - F.col("x1")).cast("double")).otherwise(F.abs(bx - ax))
    return rows.select(
        "cal_id", F.coalesce(F.nullif("label", F.lit("")), F.col("id")).alias("label"), F.col("real_distance").alias("distance_in"), width.alias("distance_px")
    ).filter(F.col("distance_px") > 1e-6)


def px_per_in(samples: DataFrame) -> DataFrame:
    return samples.groupBy("cal_id").agg(F.median(F.col("distance_px") / F.col("distance_in")).alias("px_per_in"), F.count(F.lit(1)).alias("samples"))


def detection_roi(rois: DataFrame) -> DataFrame:
    """The region to detect in: words in its note first, then lowest centre, then area."""
    words = "|".join(K.ROI_NOTE_WORDS)
    x0, y0, x1, y1 = (F.get("xyxy", F.lit(i)) for i in range(4))
    rank = F.struct(
        F.lower("note").rlike(words).cast("int").alias("word"), (0.5 * (y0 + y1)).alias("cy"),
        (F.greatest(F.lit(1), x1 - x0) * F.greatest(F.lit(1), y1 - y0)).alias("area"), (-F.col("position")).alias("first"),
    )
    return rois.groupBy("cal_id").agg(F.max_by("id", rank).alias("roi_id"))


CURRENT = "current_default"


def profile_versions(saves: DataFrame) -> DataFrame:
    """Saves (side, profile_id, saved_at, content...) as versions: `valid_from`, and `valid_to` when the next save of the profile closed it."""
    again = Window.partitionBy("side", "profile_id").orderBy("saved_at")
    return saves.withColumn("valid_to", F.lead("saved_at").over(again)).withColumnRenamed("saved_at", "valid_from")


def as_of(versions: DataFrame, at) -> DataFrame:
    """The versions that hold at a time."""
    return versions.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def default_as_of(defaults: DataFrame, at) -> DataFrame:
    """Per side the pointer set last up to a time: its `profile_id` and the content it was set to, which later saves leave alone."""
    fields = [c for c in defaults.columns if c != "side"]
    return defaults.where(F.col("set_at") <= at).groupBy("side").agg(F.max_by(F.struct(*fields), "set_at").alias("d")).select("side", "d.*")


def resolve_profiles(versions: DataFrame, defaults: DataFrame, wanted: DataFrame, at) -> DataFrame:
    """Rows (side, profile_id, ...) with the content they name at a time; null, blank and `current_default` name the side's default."""
    content = [c for c in versions.columns if c not in ("side", "profile_id", "valid_from", "valid_to")]
    named = wanted.withColumn("_id", F.nullif(F.trim(F.coalesce("profile_id", F.lit(""))), F.lit(""))).withColumn("_id", F.nullif("_id", F.lit(CURRENT)))
    held = as_of(versions, at).select("side", F.col("profile_id").alias("_id"), F.struct(*content, F.col("valid_from").alias("updated_at")).alias("_v"))
    pointed = default_as_of(defaults, at).select("side", F.struct(*content, "updated_at").alias("_d"))
    found = named.join(held, ["side", "_id"], "left").join(pointed, "side", "left")
    return found.withColumn("content", F.when(F.col("_id").isNull(), F.col("_d")).otherwise(F.col("_v"))).drop("_id", "_v", "_d").where(F.col("content").isNotNull())


def set_defaults(versions: DataFrame, defaults: DataFrame, wanted: DataFrame, at) -> DataFrame:
    """The pointers, with a new one per side of `wanted` (side, profile_id): a dated copy of what the profile is now."""
    content = [c for c in defaults.columns if c not in ("side", "profile_id", "set_at")]
    new = resolve_profiles(versions, defaults, wanted, at).select("side", F.coalesce(F.nullif(F.trim("profile_id"), F.lit("")), F.lit(CURRENT)).alias("profile_id"), F.lit(at).alias("set_at"), *[F.col(f"content.{c}").alias(c) for c in content])
    return defaults.unionByName(new.select(*defaults.columns))


def save_profiles(versions: DataFrame, defaults: DataFrame, requests: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """Saves profiles derived from others at a time: the versions and pointers after it.

    A request (side, seq, name, base_id, image_name, src_points, set_as_default) takes over its base's content but for image and
    source points. The new id is made of side, time and cleaned name. A version of that id that was open is closed; of requests
    with one id, and of those that set a side's default, the one with the largest seq counts. Requests whose base is unknown give nothing.
    """
    clean = F.trim(F.regexp_replace(F.coalesce("name", F.lit("")), r"[^\p{L}\p{N}_-]", "_"), F.lit("_"))
    stamp = F.date_format(F.lit(at), "yyyyMMdd_HHmmss")
    made = F.concat(F.lit("cam"), F.col("side"), F.lit("_homography_"), stamp, F.when(clean != "", F.concat(F.lit("_"), clean)).otherwise(""))
    based = resolve_profiles(versions, defaults, requests.withColumn("new_id", made).withColumnRenamed("base_id", "profile_id"), at)
    kept = [c for c in versions.columns if c not in ("side", "profile_id", "valid_from", "valid_to", "image_name", "src_points")]
    fields = F.struct("image_name", "src_points", *[F.col(f"content.{c}").alias(c) for c in kept])
    new = cut_lineage(based.groupBy("side", "new_id").agg(F.max_by(fields, "seq").alias("v"), F.max("seq").alias("seq"), F.max(F.when(F.col("set_as_default"), F.col("seq"))).alias("default_seq")))
    rows = new.select("side", F.col("new_id").alias("profile_id"), F.lit(at).alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), "v.*")
    closed = versions.join(new.select("side", F.col("new_id").alias("profile_id"), F.lit(True).alias("_again")), ["side", "profile_id"], "left")
    ended = F.when(F.col("_again") & F.col("valid_to").isNull(), F.lit(at)).otherwise(F.col("valid_to"))
    after = closed.withColumn("valid_to", ended).select(*versions.columns).unionByName(rows.select(*versions.columns))
    chosen = new.where("default_seq IS NOT NULL").groupBy("side").agg(F.max_by("new_id", "default_seq").alias("profile_id"))
    return after, set_defaults(after, defaults, chosen, at)


def list_profiles(versions: DataFrame, defaults: DataFrame, at) -> DataFrame:
    """Profiles of each side at a time with `updated_at`, `image_name` and `is_current`; the default itself is the row `current_default`."""
    pointed = default_as_of(defaults, at)
    rows = as_of(versions, at).join(pointed.select("side", F.col("profile_id").alias("_current")), "side", "left").select(
        "side", "profile_id", F.col("valid_from").alias("updated_at"), "image_name", F.coalesce(F.col("profile_id") == F.col("_current"), F.lit(False)).alias("is_current")
    )
    return rows.unionByName(pointed.select("side", F.lit(CURRENT).alias("profile_id"), "updated_at", "image_name", F.lit(True).alias("is_current")))


def marker_positions(rows: DataFrame, items: DataFrame, homographies: DataFrame, width: int, height: int) -> DataFrame:
    """Where match rows are drawn in the raw image, and which point that is.

    ``rows``: run_id, side, tube_number, tube_idx, match_status.  ``items``: per (run_id,
    side, tube_idx) measured x, ref_x, y, refined point, box centre, box corners; the last
    item of an index counts.  ``homographies``: h11..h33 per side.
    """
    fields = [n for n in items.columns if n not in ("run_id", "side", "tube_idx", "source_order")]
    last = items.groupBy("run_id", "side", "tube_idx").agg(F.max_by(F.struct(*fields), "source_order").alias("i"))
    joined = rows.join(last, ["run_id", "side", "tube_idx"]).join(invert_matrix(homographies), "side")

    def back(x: str, y: str):
        px, py = project(x, y, "g")
        fit = lambda v, size: F.greatest(F.lit(0.0), F.least(F.lit(float(size - 1)), v))
        return F.when(px.isNotNull() & py.isNotNull(), F.struct(fit(px, width).alias("x"), fit(py, height).alias("y")))

    joined = joined.withColumns(
        {
            "calc": back("i.x", "i.y"), "ref": back("i.ref_x", "i.y"), "refined": back("i.refined_x", "i.refined_y"), "centre": back("i.box_x", "i.box_y"),
            "corners": back("((i.x1 + i.x2) * 0.5D)", "((i.y1 + i.y2) * 0.5D)"),
        }
    )
    prefer_ref = (F.col("side") == "152") & F.col("ref").isNotNull()
    legacy = F.when(prefer_ref, F.col("ref")).otherwise(F.coalesce("calc", "ref"))
    source = (
        F.when(F.col("refined").isNotNull(), "refined_pipe_end").when(F.col("centre").isNotNull(), "yolo_box_center")
        .when(F.col("corners").isNotNull(), "box_xyxy_center").when(prefer_ref | F.col("calc").isNull(), "legacy_ref_fallback").otherwise("legacy_calc_fallback")
    )
    drawn = joined.filter(F.col("calc").isNotNull() | F.col("ref").isNotNull()).withColumn("v", F.coalesce("refined", "centre", "corners", legacy))
    return drawn.select(
        "run_id", "side", "tube_number", "tube_idx", F.bround("v.x", 3).alias("x"), F.bround("v.y", 3).alias("y"), source.alias("visual_source"),
        F.bround("calc.x", 3).alias("calc_x"), F.bround("ref.x", 3).alias("ref_x"),
    )
