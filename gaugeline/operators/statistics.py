"""Statistics over images and cameras."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.arrays import let
from gaugeline.functions.quantiles import exact_median
from gaugeline.functions.scalars import positive
from gaugeline.operators.boxes import IMAGE
from gaugeline.session import broadcast_if_small, cut_lineage


def length_percent(rows: DataFrame) -> DataFrame:
    """Length as percent of the longest of its run, between 18 and 100; 42 when missing."""
    longest = F.max("length_in").over(Window.partitionBy("run_id"))
    share = F.greatest(F.lit(18.0), F.least(F.lit(100.0), F.col("length_in") / longest * 100))
    return rows.withColumn("width_percent", F.when(F.col("length_in").isNull(), 42.0).otherwise(share))


def image_medians(boxes: DataFrame, value: str) -> DataFrame:
    """Positive median and upper median of a box value per image."""
    from gaugeline.functions.arrays import upper_median

    return boxes.groupBy(*IMAGE).agg(
        F.median(positive(F.col(value))).alias("median"), upper_median(F.collect_list(value)).alias("upper")
    )


def mean_variance(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("variance")
    )


def spacing_stats(labels: DataFrame, min_gaps: int = 10) -> DataFrame:
    """Spacing of neighbours per camera from rows (camera, img, y); none below ten gaps.

    A camera may hold any share of the data: its gaps are written once, its medians come from
    histograms of fixed size (see functions.quantiles), and what is broadcast has a row per camera.
    """
    down = Window.partitionBy("camera", "img").orderBy("y")
    above = labels.select("camera", "img", "y", (F.col("y") - F.lag("y").over(down)).alias("v"))
    seen = F.count_if(F.col("v") > 0).over(down.rowsBetween(Window.unboundedPreceding, 0))
    gaps = cut_lineage(above.withColumn("seen", seen).filter(F.col("v") > 0).select("camera", "v", (F.col("seen") == 1).alias("opening")))
    key = ["camera"]
    totals = gaps.groupBy("camera").agg(F.count(F.lit(1)).alias("raw_spacing_count"), F.count_if("opening").alias("sample_image_count"))
    raw = broadcast_if_small(exact_median(gaps.filter(F.col("v") > 1e-6), key, "raw").drop("total"))
    central = gaps.join(raw, key).filter(F.col("v").between(0.35 * F.col("raw"), 2.50 * F.col("raw"))).select("camera", "v", "raw")
    middle = exact_median(central.filter(F.col("v") > 1e-6), key, "median_gap").drop("total")
    mean = central.groupBy("camera").agg(
        F.count(F.lit(1)).alias("spacing_count"), F.avg("v").alias("mean_gap_px"), F.var_pop("v").alias("variance_gap_px"), F.first("raw").alias("raw"),
    )
    base = broadcast_if_small(
        totals.join(mean, key).join(middle, key, "left")
        .withColumn("median_gap_px", F.coalesce("median_gap", "raw")).drop("median_gap", "raw")
    )
    around = central.join(base.select("camera", "median_gap_px"), key)
    deviations = around.select("camera", F.abs(F.col("v") - F.col("median_gap_px")).alias("v")).filter(F.col("v") > 1e-6)
    mad = exact_median(deviations, key, "mad").drop("total")
    m, sigma = F.col("median_gap_px"), 1.4826 * F.col("mad_gap_px")
    allowed = F.greatest(
        1.65 * m, m + 4.0 * sigma, F.when(F.col("std_gap_px") > 0, F.col("mean_gap_px") + 2.0 * F.col("std_gap_px"))
    )
    return (
        base.join(mad, key, "left")
        .withColumn("mad_gap_px", F.coalesce("mad", F.lit(0.0))).drop("mad")
        .withColumn("std_gap_px", F.sqrt("variance_gap_px"))
        .withColumn("allowed_gap_px", F.least(allowed, 3.0 * m))
        .filter(F.col("raw_spacing_count") >= min_gaps)
    )


def height_fit(boxes: DataFrame) -> DataFrame:
    """Line of box height over normalised y and their correlation, per camera."""
    x, y = F.col("y_norm"), F.col("h")
    sums = boxes.groupBy("camera").agg(
        F.count(F.lit(1)).alias("n"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.avg(y).alias("mean_h"),
        F.regr_slope(y, x).alias("slope_"), F.regr_intercept(y, x).alias("intercept_"), F.corr(x, y).alias("corr_"),
    )
    flat = F.col("vx") * F.col("n") <= 1e-12
    null = F.sqrt(F.least("vx", "vy") * F.col("n")) <= 1e-12
    return sums.select(
        "camera", "n", F.when(flat, 0.0).otherwise(F.col("slope_")).alias("slope"),
        F.when(flat, F.col("mean_h")).otherwise(F.col("intercept_")).alias("intercept"),
        F.when(~null, F.col("corr_")).alias("pearson"),
    )


def height_bins(boxes: DataFrame, bins: int) -> DataFrame:
    """Count, median, mean, min and max height per camera and equal-width y bin."""
    inside = boxes.filter(F.col("y_norm").between(0.0, 1.0))
    place = F.least(F.floor(F.col("y_norm") * bins), F.lit(bins - 1)).cast("int") + 1
    binned = inside.select("camera", place.alias("bin"), "h")
    stats = binned.groupBy("camera", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("h").alias("mean_h"), F.min("h").alias("min_h"), F.max("h").alias("max_h")
    )
    median = exact_median(binned, ["camera", "bin"], "median_h", "h").drop("total")
    every = boxes.select("camera").distinct().withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    filled = every.join(stats, ["camera", "bin"], "left").join(median, ["camera", "bin"], "left")
    return filled.withColumn("n", F.coalesce("n", F.lit(0)))


def height_outliers(boxes: DataFrame, z: float = 2.5) -> DataFrame:
    """Boxes whose height is far from the fitted line of their camera, with a robust z."""
    # one row per camera: the boxes themselves are never shuffled
    fit = broadcast_if_small(height_fit(boxes).select("camera", "slope", "intercept"))
    rows = (
        boxes.join(fit, "camera")
        .withColumn("expected", F.col("intercept") + F.col("slope") * F.col("y_norm"))
        .withColumn("residual", F.col("h") - F.col("expected"))
        .withColumn("ratio", F.when(F.col("expected") > 1e-6, F.col("h") / F.when(F.col("expected") > 1e-6, F.col("expected"))))
        .drop("slope", "intercept")
    )
    sizes = rows.select("camera", F.abs("residual").alias("v"))
    center = broadcast_if_small(exact_median(sizes, ["camera"], "center").drop("total"))
    apart = sizes.join(center, "camera").select("camera", F.abs(F.col("v") - F.col("center")).alias("v"))
    scale = broadcast_if_small(exact_median(apart, ["camera"], "mad").select(
        "camera", F.greatest(F.lit(1e-6), 1.4826 * F.col("mad")).alias("scale")
    ))
    scored = rows.join(scale, "camera").withColumn("z", F.abs("residual") / F.col("scale")).drop("scale")
    return scored.filter(F.col("z") >= z)


def side_scale(items: DataFrame) -> DataFrame:
    """Median reference x and pixels per inch of one side, from metadata when given."""
    sample = F.abs("offset_px") / F.nullif(F.col("distance_in"), F.lit(0.0))
    return items.groupBy("run_id", "side").agg(
        F.median("ref_x").alias("ref_x"), F.coalesce(F.first("px_per_in", True), F.median(sample)).alias("px_per_in")
    )


def polygon_y_bounds(df: DataFrame, names: list[str]) -> DataFrame:
    """Lowest and highest y over several point lists; needs two points."""
    ys = F.transform(F.flatten(F.array(*[F.coalesce(n, F.array().cast("array<struct<x:double,y:double>>")) for n in names])), lambda p: p["y"])
    listed = df.withColumn("_ys", F.filter(ys, lambda v: v.isNotNull()))
    enough = F.size("_ys") >= 2
    return listed.withColumn("top", F.when(enough, F.array_min("_ys"))).withColumn("bottom", F.when(enough, F.array_max("_ys"))).drop("_ys")


def roughness(points) -> object:
    """Population deviation of successive x differences; 0 under three points."""
    xs = F.transform(points, lambda p: p["x"])
    n = F.size(xs) - 1
    steps = F.zip_with(F.slice(xs, F.lit(2), F.greatest(n, F.lit(0))), F.slice(xs, F.lit(1), F.greatest(n, F.lit(0))), lambda b, a: b - a)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    count = F.greatest(n, F.lit(1)).cast("double")
    # steps and mean are told once, not once for each step
    spread = let(steps, lambda s: let(total(s) / count, lambda mean: total(F.transform(s, lambda d: (d - mean) * (d - mean)))))
    return F.when(F.size(xs) < 3, 0.0).otherwise(F.sqrt(spread / count))


def span_prompt(boxes: DataFrame, images: DataFrame, spacing: DataFrame | None = None) -> DataFrame:
    """Envelope of the main stack of each image with margins, inside the image."""
    from gaugeline.functions.arrays import upper_median
    from gaugeline.operators.boxes import isolated_clusters

    usable = boxes.filter((F.col("w") > 1.0) & (F.col("h") > 1.0))
    stack = isolated_clusters(usable, spacing, unchanged_below=3, default_height=16.0)
    first = F.struct("yc", "box_id")
    shape = stack.groupBy(*IMAGE).agg(
        F.count(F.lit(1)).alias("n"), upper_median(F.collect_list("h")).alias("mh"), upper_median(F.collect_list("w")).alias("mw"),
        F.min_by("y1", first).alias("top"), F.max_by("y2", first).alias("low"),
        F.min("x1").alias("left"), F.max("x2").alias("right"),
    ).join(images.select("img", "width", "height"), "img")
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    strip = F.greatest(F.lit(48.0), 6.0 * F.col("mw"), 0.31 * w)
    placed = shape.select(
        *IMAGE, "n", F.lit(0.0).alias("x1"),
        F.greatest(F.lit(1.0), F.col("top") - F.greatest(F.lit(24.0), 2.0 * F.col("mh"))).alias("y1"),
        F.least(w, F.col("right") + F.greatest(F.lit(12.0), 0.75 * F.col("mw"))).alias("x2"),
        F.least(h, F.col("low") + F.greatest(F.lit(10.0), 0.6 * F.col("mh"))).alias("y2"),
        F.greatest(F.lit(0.0), F.col("left") - strip).alias("crop_x1"),
    )
    return placed.filter((F.col("x2") > F.col("x1") + 2.0) & (F.col("y2") > F.col("y1") + 2.0))
