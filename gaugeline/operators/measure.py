"""From boxes to measured items: reference lines, offsets, residuals, text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import scalars as S


def x_on_line(x0: Column, y0: Column, x1: Column, y1: Column, y: Column, flat: float = 1e-6) -> Column:
    """x of a two-point line at height y; a horizontal line gives its middle."""
    rise = y1 - y0
    steep = F.when(F.abs(rise) > flat, rise)
    return F.when(steep.isNull(), 0.5 * (x0 + x1)).otherwise(x0 + (y - y0) / steep * (x1 - x0))


def ref_x_at_y(points: DataFrame, lines: DataFrame, key: str = "side") -> DataFrame:
    """Adds ref_x: on the line of the key where there is one, else its constant x."""
    on_line = x_on_line(F.col("lx0"), F.col("ly0"), F.col("lx1"), F.col("ly1"), F.col("y"))
    whole = F.col("lx0").isNotNull() & F.col("lx1").isNotNull() & F.col("y").isNotNull()
    return points.join(lines, key, "left").withColumn("ref_x", F.when(whole, on_line).otherwise(F.col("const_x")))


def reference_lines(lines: DataFrame, keys: list[str], preferred: Column) -> DataFrame:
    """The line to measure from: the preferred label, else the last one."""
    best = F.max_by(F.struct("label", "lx0", "ly0", "lx1", "ly1"), F.struct((F.col("label") == preferred).cast("int"), "line_no"))
    return lines.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")


def measure_offsets(boxes: DataFrame, calibration: DataFrame, key: str = "side") -> DataFrame:
    """Offset in pixels and distance in inches from the reference line.

    ``calibration`` has one row per key: the line and px_per_in.  Boxes whose line or
    scale is missing get an ``error`` instead of a distance.
    """
    ref = x_on_line(F.col("lx0"), F.col("ly0"), F.col("lx1"), F.col("ly1"), F.col("yc"), 1e-8)
    scale = F.when(F.col("px_per_in") > 1e-6, F.col("px_per_in"))
    measured = (
        boxes.join(calibration, key, "left")
        .withColumn("ref_x", ref)
        .withColumn("offset_px", F.col("xc") - F.col("ref_x"))
        .withColumn("distance_in", F.abs("offset_px") / scale)
    )
    error = F.when(scale.isNull(), "no_scale").when(F.col("lx0").isNull() | F.col("lx1").isNull(), "no_line")
    position = F.when(F.col("side") == "152", F.when(F.col("offset_px") < 0, "after").otherwise("before"))
    return measured.withColumn("error", error).withColumn("relative_position", position).drop(
        "lx0", "ly0", "lx1", "ly1", "px_per_in", "label"
    )


def offset_class(offset: Column) -> Column:
    return F.when(offset < 0, "negative").when(offset > 0, "positive").when(offset.isNotNull(), "zero")


def normalize_items(raw: DataFrame, *others: str) -> DataFrame:
    """Raw measurement rows (text fields) to typed items; bad distances carry an error. The columns `others` go along."""
    index = F.coalesce(S.lenient_int(F.col("raw_tube_idx")), F.col("position") + 1)
    offset = S.lenient_double(F.col("raw_offset"))
    distance = S.lenient_double(F.col("raw_distance"))
    given = F.lower(F.trim(F.col("raw_relative")))
    relative = F.when(given.isin("before", "after"), given).otherwise(
        F.when(offset < 0, "after").otherwise("before")
    )
    typed = raw.select(
        "run_id", "side", "position",
        index.alias("tube_idx"), distance.alias("distance_in"), offset.alias("offset_px"),
        offset_class(offset).alias("offset_direction"),
        F.when(F.col("side") == "152", relative).alias("relative_position"),
        F.when(distance.isNull(), "distance_missing").alias("error"), *others,
    )
    padded = lambda c: F.when(F.length(c.cast("string")) < 3, F.lpad(c.cast("string"), 3, "0")).otherwise(c.cast("string"))
    rows = typed.withColumn("id", F.concat_ws("-", "side", padded(F.col("tube_idx")), padded(F.col("position"))))
    return rows.select(*[c for c in rows.columns if c not in others], *others)


def match_values(rows: DataFrame) -> DataFrame:
    """Adds r151, r152 and total_length_in to paired rows."""
    return (
        rows.withColumn("r151", S.residual_left(F.col("measurement_151")))
        .withColumn("r152", S.residual_right(F.col("measurement_152"), F.col("r152_position")))
        .withColumn("total_length_in", S.total_length(F.col("r151"), F.col("r152")))
    )


def display_rows(rows: DataFrame) -> DataFrame:
    """Match rows as the length table shows them."""
    length = F.col("total_length_in")
    two_decimals = F.format_string("%.2f", F.bround(length, 2))
    return rows.select(
        "run_id", "tube_number", "match_status",
        length.alias("length_in"),
        F.when(length.isNull(), "-").otherwise(two_decimals).alias("length_in_display"),
        S.format_feet(length).alias("length_ft_display"),
        S.length_group(F.col("match_status"), length).alias("length_group"),
        S.marker_color(F.col("match_status")).alias("color"),
    )


def clip_boxes(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """Clamp to the image and drop what has no area left."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    clipped = (
        boxes.join(images.select("img", "width", "height"), "img")
        .withColumn("x1", S.clamp(F.col("x1"), 0.0, w)).withColumn("y1", S.clamp(F.col("y1"), 0.0, h))
        .withColumn("x2", S.clamp(F.col("x2"), 0.0, w)).withColumn("y2", S.clamp(F.col("y2"), 0.0, h))
    )
    return clipped.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def clip_sized(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """Boxes given as x, y, w, h: the corner is clamped first, then the size to what is left."""
    width, height = F.col("width").cast("double"), F.col("height").cast("double")
    placed = boxes.join(images.select("img", "width", "height"), "img").withColumns(
        {"x": S.clamp(F.col("x"), 0.0, width), "y": S.clamp(F.col("y"), 0.0, height)}
    )
    sized = placed.withColumns({"w": F.greatest(F.lit(0.0), F.least(width - F.col("x"), F.col("w"))), "h": F.greatest(F.lit(0.0), F.least(height - F.col("y"), F.col("h")))})
    return sized.filter((F.col("w") > 0) & (F.col("h") > 0))


def normalize_rect(df: DataFrame, width, height, least: float = 5.0) -> DataFrame:
    """Order and clamp rectangle corners; rectangles under five pixels are dropped."""
    w, h = F.lit(float(width)), F.lit(float(height))
    ax, bx = S.clamp(F.col("x0"), 0.0, w), S.clamp(F.col("x1"), 0.0, w)
    ay, by = S.clamp(F.col("y0"), 0.0, h), S.clamp(F.col("y1"), 0.0, h)
    ordered = df.withColumns(
        {"x0": F.least(ax, bx), "x1": F.greatest(ax, bx), "y0": F.least(ay, by), "y1": F.greatest(ay, by)}
    )
    return ordered.filter((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))


def clamp_point(x: Column, y: Column, width, height) -> Column:
    """Clamped point rounded to three decimals; null when a value is not finite."""
    inf = F.lit(float("inf"))
    usable = (F.abs(x) < inf) & (F.abs(y) < inf) & ~F.isnan(x) & ~F.isnan(y)
    return F.when(
        usable,
        F.struct(
            F.bround(S.clamp(x, 0.0, float(width)), 3).alias("x"), F.bround(S.clamp(y, 0.0, float(height)), 3).alias("y")
        ),
    )


def fixed6(value: Column) -> Column:
    """Six decimals, rounded half to even; common values are printed as decimals, which is quicker."""
    rounded = F.bround(value, 6)
    return F.when((value > 0) & (value < 1e9), rounded.cast("decimal(16,6)").cast("string")).otherwise(F.format_string("%.6f", rounded))


def rebase_line(line: Column, old: tuple, new: tuple) -> Column:
    """One normalised label line moved from an old crop to a new one.

    ``old`` and ``new`` are (x0, y0, x1, y1) as columns or numbers.
    """
    old, new = [[v if isinstance(v, Column) else F.lit(float(v)) for v in rect] for rect in (old, new)]
    parts = F.split(F.trim(line), r"\s+")
    ow, oh, nw, nh = old[2] - old[0], old[3] - old[1], new[2] - new[0], new[3] - new[1]
    number = lambda i: F.get(parts, i).try_cast("double")
    unit = lambda v: fixed6(S.clamp(v, 0.0, 1.0))
    moved = F.concat_ws(
        " ",
        F.get(parts, 0),
        unit((number(1) * ow + (old[0] - new[0])) / nw),
        unit((number(2) * oh + (old[1] - new[1])) / nh),
        unit(number(3) * ow / nw),
        unit(number(4) * oh / nh),
        F.when(F.size(parts) == 6, F.get(parts, 5)),
    )
    return F.when(F.size(parts) < 5, F.trim(line)).otherwise(moved)


def crop_box(df: DataFrame) -> DataFrame:
    """Crop window of a digital framing (zoom_factor, offset_x, offset_y) in an image."""
    zoom = F.greatest(F.lit(1.0), F.coalesce(F.nullif(F.col("zoom_factor"), F.lit(0.0)), F.lit(1.0)))
    w, h = F.col("src_width").cast("double"), F.col("src_height").cast("double")
    sized = df.withColumn("crop_w", F.greatest(F.lit(1.0), F.rint(w / zoom))).withColumn(
        "crop_h", F.greatest(F.lit(1.0), F.rint(h / zoom))
    )
    left = F.rint(w / 2.0 + F.coalesce("offset_x", F.lit(0.0)) * F.col("crop_w") - F.col("crop_w") / 2.0)
    top = F.rint(h / 2.0 + F.coalesce("offset_y", F.lit(0.0)) * F.col("crop_h") - F.col("crop_h") / 2.0)
    placed = sized.withColumn("left", S.clamp(left, 0.0, F.greatest(F.lit(0.0), w - F.col("crop_w")))).withColumn(
        "top", S.clamp(top, 0.0, F.greatest(F.lit(0.0), h - F.col("crop_h")))
    )
    return placed.withColumn("right", F.col("left") + F.col("crop_w")).withColumn("bottom", F.col("top") + F.col("crop_h"))


def effective_config(cameras: DataFrame, general: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Camera values over general values, field by field; sequence aliases resolved."""
    joined = cameras.alias("c").join(general.alias("g"), key, "left")
    merged = joined.select(
        *[F.col(f"c.{c}") for c in cameras.columns if c not in fields],
        *[F.coalesce(F.col(f"c.{f}"), F.col(f"g.{f}")).alias(f) for f in fields],
    )
    wide = F.coalesce("force_wide", F.lit(True))
    return merged.withColumn("sequence", S.movement_sequence(F.col("sequence"))).withColumn(
        "zoom", F.when(wide, F.coalesce("capture_zoom", F.lit(0))).otherwise(F.col("zoom"))
    )


def ptz_reached(df: DataFrame) -> DataFrame:
    """Whether the camera stands within the tolerances of its target."""
    near = lambda name, limit: F.abs(F.col(f"actual_{name}") - F.col(f"target_{name}")) <= limit
    return df.withColumn("reached_target", near("zoom", 8.0) & near("pan", 0.8) & near("tilt", 0.8))


def weighted_distance(a: Column, b: Column, weights: Column, missing: float = 999.0) -> Column:
    """Weighted Euclidean distance of two short vectors."""
    scaled = F.zip_with(F.zip_with(a, b, lambda p, q: p.cast("double") - q.cast("double")), weights, lambda d, w: d * w)
    total = F.aggregate(scaled, F.lit(0.0), lambda acc, d: acc + d * d)
    return F.coalesce(F.sqrt(total), F.lit(missing))


def residual_columns(items: DataFrame) -> DataFrame:
    left = S.residual_left(F.col("distance_in"))
    right = S.residual_right(F.col("distance_in"), F.col("relative_position"))
    return items.withColumn("residual", F.when(F.col("side") == "151", left).otherwise(right))
