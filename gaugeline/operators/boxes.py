"""Box cleaning of one image at a time.

The detector emits at most 256 boxes per image, so an image is a bounded group: greedy
rules run as folds over one array per image, everything else as windows over the same
partitioning.  A full chain therefore needs one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline import constants as K
from gaugeline.functions import boxes as G
from gaugeline.functions.scalars import positive

IMAGE = ["run_id", "side", "img"]
FIELDS = ["yc", "box_id", "xc", "w", "h", "x1", "y1", "x2", "y2", "conf", "flags"]


def pack(boxes: DataFrame, name: str = "boxes") -> DataFrame:
    """One row per image with its boxes as an array."""
    return boxes.groupBy(*IMAGE).agg(F.collect_list(F.struct(*FIELDS)).alias(name))


def explode_boxes(packed: DataFrame, array, *others) -> DataFrame:
    """Rows (keys, b) of an array of boxes.

    A plain explode makes the optimizer test the array for being empty below the
    projections that compute it, and so copy every fold into a filter.
    """
    return packed.select(*IMAGE, *others, F.explode_outer(array).alias("b")).filter(F.col("b").isNotNull())


def unpack(packed: DataFrame, name: str = "boxes") -> DataFrame:
    return explode_boxes(packed, name).select(*IMAGE, "b.*")


def top_down() -> object:
    return Window.partitionBy(*IMAGE).orderBy("yc", "box_id")


def whole_image() -> object:
    return Window.partitionBy(*IMAGE)


# Folds over the array of one image ------------------------------------------------


def drop_tiny(boxes: Column) -> Column:
    return F.filter(boxes, lambda b: G.area(b) > 1.0)


def touching_runs(boxes: Column) -> Column:
    """The boxes as an array of arrays: going down, a new one begins below everything that came before.

    Boxes of different arrays share no area, so rules on touching boxes hold inside each array.
    """
    ordered = F.array_sort(F.transform(boxes, lambda b: F.struct(b["y1"].alias("y"), b.alias("b"))))
    none = F.slice(boxes, 1, 0)

    def step(state, s):
        below = s["y"] >= state["reach"]
        return F.struct(
            F.when(below, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"),
            F.when(below, F.array(s["b"])).otherwise(F.concat(state["open"], F.array(s["b"]))).alias("open"),
            F.greatest(state["reach"], s["b"]["y2"]).alias("reach"),
        )

    start = F.struct(F.array(none).alias("done"), none.alias("open"), F.lit(None).cast("double").alias("reach"))
    return F.aggregate(ordered, start, step, lambda state: F.concat(state["done"], F.array(state["open"])))


def drop_containers(
    boxes: Column, ratio: float = K.CONTAINMENT_RATIO, children: int = K.CONTAINED_CHILDREN
) -> Column:
    """Remove boxes that cover most of several smaller boxes."""

    def covers(big):
        return lambda small: G.touching(big, small) & (G.area(big) > G.area(small)) & (
            G.intersection(big, small) / F.greatest(G.area(small), F.lit(1.0)) >= ratio
        )

    def without(run):
        # a container has itself and its children in its run
        return F.when(F.size(run) <= children, run).otherwise(F.filter(run, lambda b: F.size(F.filter(run, covers(b))) < children))

    return F.flatten(F.transform(touching_runs(boxes), without))


def suppress_overlaps(boxes: Column, limit: float = K.OVERLAP_LIMIT) -> Column:
    """Keep the strongest boxes; drop what overlaps a kept box by more than the limit."""

    def step(kept, ranked_box):
        box = ranked_box["b"]
        clash = F.exists(kept, lambda other: G.touching(other, box) & (G.overlap_over_smaller(other, box) > limit))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(box)))

    def strongest(run):
        ranked = F.array_sort(F.transform(run, lambda b: F.struct((-b["conf"]).alias("k"), G.area(b).alias("a"), b.alias("b"))))
        return F.when(F.size(run) < 2, run).otherwise(F.aggregate(ranked, F.slice(run, 1, 0), step))

    return F.flatten(F.transform(touching_runs(boxes), strongest))


def collapse_vertical(
    boxes: Column,
    height_ratio: float = K.VERTICAL_HEIGHT_RATIO,
    overlap: float = K.VERTICAL_OVERLAP,
    band: float = K.VERTICAL_BAND_OVERLAP,
    counted: bool = False,
) -> Column:
    """Going down, merge a box into the last kept one when both show the same object.

    With ``counted``: a struct of these boxes (kept) and how many were merged for their band alone, far apart sideways (n).
    """
    ordered = F.array_sort(boxes)

    def flagged(box, flag):
        return box.withField("flags", F.concat(box["flags"], F.array(flag)))

    def step(state, box):
        kept, n = state["kept"], state["n"]
        last = F.element_at(kept, -1)
        near = (F.abs(box["yc"] - last["yc"]) < height_ratio * F.greatest(box["h"], last["h"])) | (
            G.overlap_over_smaller(box, last) >= overlap
        )
        beside = F.abs(box["xc"] - last["xc"]) <= 1.25 * F.greatest(box["w"], last["w"])
        same_band = G.vertical_overlap_over_smaller(box, last) >= band
        flag = F.when(same_band, K.FLAG_SAME_BAND).otherwise(K.FLAG_VERTICAL)
        winner = F.when(box["conf"] > last["conf"], flagged(box, flag)).otherwise(flagged(last, flag))
        head = F.slice(kept, F.lit(1), F.size(kept) - 1)
        after = F.when((near & beside) | same_band, F.concat(head, F.array(winner))).otherwise(F.concat(kept, F.array(box)))
        return F.struct(after.alias("kept"), (n + (same_band & ~(near & beside)).cast("bigint")).alias("n"))

    start = F.struct(F.slice(ordered, 1, 1).alias("kept"), F.lit(0).cast("bigint").alias("n"))
    rest = F.slice(ordered, F.lit(2), F.greatest(F.size(ordered), F.lit(1)))
    return F.aggregate(rest, start, step, lambda state: state if counted else state["kept"])


def dedupe_stages(packed: DataFrame) -> DataFrame:
    """Adds the array after each of the three suppression stages."""
    return (
        packed.withColumn("valid", drop_tiny(F.col("boxes")))
        .withColumn("single", drop_containers(F.col("valid")))
        .withColumn("strong", suppress_overlaps(F.col("single")))
        .withColumn("merged", collapse_vertical(F.col("strong"), counted=True))
        .withColumn("final", F.col("merged.kept"))
    )


def dedupe(packed: DataFrame) -> DataFrame:
    return dedupe_stages(packed).select(*IMAGE, F.col("final").alias("boxes"))


def suppression_audit(packed: DataFrame) -> DataFrame:
    """Counters of the suppression stages, one row per image."""
    n = {name: F.size(name).cast("bigint") for name in ("boxes", "valid", "single", "strong", "final")}
    return dedupe_stages(packed).select(
        *IMAGE,
        n["boxes"].alias("raw_count"),
        n["valid"].alias("valid_count"),
        (n["valid"] - n["single"]).alias("removed_large_containers"),
        (n["single"] - n["strong"]).alias("suppressed_overlap"),
        (n["strong"] - n["final"]).alias("suppressed_vertical_duplicate"),
        F.col("merged.n").alias("suppressed_vertical_y_duplicate"),
        n["final"].alias("final_count"),
    )


# Windows over the rows of one image -------------------------------------------------


def gaps(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("gap", F.lead("yc").over(top_down()) - F.col("yc"))


def robust_pitch(
    boxes: DataFrame, low: float = 0.45, high: float = 1.75, height_floor: float | None = 1.10
) -> DataFrame:
    """Typical distance of neighbours per image; null with fewer than two boxes."""
    raw = F.median(positive(F.abs(F.col("gap")))).over(whole_image())
    size = F.median(positive(F.col("h"))).over(whole_image())
    spread = gaps(boxes).select(*IMAGE, "gap", "h", raw.alias("raw"), size.alias("size"))
    central = F.abs(F.col("gap")).between(low * F.col("raw"), high * F.col("raw"))
    per_image = spread.groupBy(*IMAGE).agg(
        F.count(F.lit(1)).alias("n"),
        F.first("raw").alias("raw"),
        F.first("size").alias("size"),
        F.median(positive(F.when(central, F.abs(F.col("gap"))))).alias("central"),
    )
    pitch = F.coalesce("central", "raw")
    if height_floor is not None:
        pitch = F.when(F.col("raw").isNull(), 1.15 * F.col("size")).otherwise(
            F.greatest(pitch, height_floor * F.col("size"))
        )
    return per_image.select(*IMAGE, "n", F.when(F.col("n") >= 2, pitch).alias("pitch"))


def isolated_clusters(boxes: DataFrame, spacing: DataFrame | None = None, **limits) -> DataFrame:
    """Drop groups of boxes that stand apart from the stack.

    ``spacing`` (side, median_gap_px, allowed_gap_px) has one row per camera and sets
    the allowed gap; without it the gap follows from the image itself.
    """
    min_size = limits.get("min_cluster", K.MIN_CLUSTER)
    ratio = limits.get("gap_ratio", K.CLUSTER_GAP_RATIO)
    min_gap = limits.get("min_gap_px", K.CLUSTER_MIN_GAP_PX)
    image, order = whole_image(), top_down()
    gap = F.col("yc") - F.lag("yc").over(order)
    tall = F.coalesce(F.median(positive(F.col("h"))).over(image), F.lit(limits.get("default_height", 1.0)))
    rows = boxes.withColumns(
        {"_gap": gap, "_tall": tall, "_n": F.count(F.lit(1)).over(image)}
    )
    local = F.col("_gap") <= F.greatest(F.lit(min_gap), 4.0 * F.col("_tall"))
    pitch = F.coalesce(
        F.median(positive(F.when(local, F.col("_gap")))).over(image),
        F.median(positive(F.col("_gap"))).over(image),
        1.4 * F.col("_tall"),
    )
    rows = rows.withColumn(
        "_break", F.greatest(F.lit(min_gap), ratio * pitch, 3.5 * F.col("_tall"))
    )
    if spacing is not None:
        known = spacing.filter((F.col("median_gap_px") > 1e-6) & (F.col("allowed_gap_px") > 1e-6))
        rows = rows.join(F.broadcast(known.select("side", "allowed_gap_px")), "side", "left").withColumn(
            "_break", F.coalesce("allowed_gap_px", "_break")
        ).drop("allowed_gap_px")
    rows = rows.withColumn(
        "_cluster", F.sum(F.when(F.col("_gap") > F.col("_break"), 1).otherwise(0)).over(order)
    )
    cluster = Window.partitionBy(*IMAGE, "_cluster")
    rows = rows.withColumn("_size", F.count(F.lit(1)).over(cluster))
    best = F.max(F.struct(F.col("_size"), (-F.col("_cluster")).alias("c"))).over(image)
    rows = rows.withColumn("_best", best)
    keep = (
        (F.col("_n") < limits.get("unchanged_below", max(4, min_size + 1)))
        | (F.col("_size") >= max(1, min_size))
        | ((F.col("_best")["_size"] < max(1, min_size)) & (F.col("_cluster") == -F.col("_best")["c"]))
    )
    return rows.filter(keep).drop("_gap", "_tall", "_n", "_break", "_cluster", "_size", "_best")


def lateral_outliers(boxes: DataFrame, base_conf: float = K.DETECTOR_CONF) -> DataFrame:
    """Marks each box: kept, kept_far (far from the line but confident) or removed."""
    need = max(K.FAR_X_MIN_CONF, base_conf + K.FAR_X_EXTRA_CONF)
    order = top_down()
    typical = F.coalesce(F.median(positive(F.col("w"))).over(whole_image()), F.lit(1.0))
    rows = boxes.withColumns(
        {
            "_limit": F.greatest(F.lit(K.FAR_X_MIN_PX), K.FAR_X_RATIO * typical),
            "_uy": F.lag("yc").over(order),
            "_ux": F.lag("xc").over(order),
            "_ly": F.lead("yc").over(order),
            "_lx": F.lead("xc").over(order),
        }
    )
    span = F.col("_ly") - F.col("_uy")
    share = (F.col("yc") - F.col("_uy")) / F.when(F.abs(span) > 1e-6, span)
    expected = F.col("_ux") + F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * (F.col("_lx") - F.col("_ux"))
    far = F.abs(span).isNotNull() & (F.abs(span) > 1e-6) & (F.abs(F.col("xc") - expected) > F.col("_limit"))
    verdict = F.when(~F.coalesce(far, F.lit(False)), "kept").when(F.col("conf") >= need, "kept_far").otherwise("removed")
    rows = rows.withColumn("verdict", verdict)
    flags = F.when(F.col("verdict") == "kept_far", F.array_append("flags", F.lit(K.FLAG_FAR_X))).otherwise(F.col("flags"))
    return rows.withColumn("flags", flags).drop("_limit", "_uy", "_ux", "_ly", "_lx")


def drop_lateral_outliers(boxes: DataFrame, base_conf: float = K.DETECTOR_CONF) -> DataFrame:
    return lateral_outliers(boxes, base_conf).filter(F.col("verdict") != "removed").drop("verdict")


def removed_sample(boxes: DataFrame, base_conf: float = K.DETECTOR_CONF, n: int = 12) -> DataFrame:
    """The first n removed boxes of each image, as the audit lists them."""
    removed = lateral_outliers(boxes, base_conf).filter(F.col("verdict") == "removed")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("yc", "box_id"))), lambda b: b["box_id"])
    return removed.groupBy(*IMAGE).agg(
        F.count(F.lit(1)).alias("removed_count"), F.array_join(F.slice(ids, 1, n), ",").alias("removed")
    )


def number_boxes(boxes: DataFrame) -> DataFrame:
    """Numbers from the top and from the bottom of each image."""
    down = F.row_number().over(top_down())
    return boxes.withColumn("tube_idx", down).withColumn(
        "from_bottom", (F.count(F.lit(1)).over(whole_image()) - F.col("tube_idx") + 1).cast("int")
    )


def oversize_boxes(boxes: DataFrame) -> DataFrame:
    """Marks tall boxes and estimates how many objects each of them holds."""
    image, order = whole_image(), top_down()
    rows = boxes.withColumns(
        {
            "median_h": F.median(positive(F.col("h"))).over(image),
            "_median_w": F.coalesce(F.median(positive(F.col("w"))).over(image), F.lit(0.0)),
            "_up": positive(F.lag("h").over(order)),
            "_low": positive(F.lead("h").over(order)),
            "_low_dx": F.lead("xc").over(order) - F.col("xc"),
            "_n": F.count(F.lit(1)).over(image),
        }
    )
    nearby = F.coalesce(0.5 * (F.col("_up") + F.col("_low")), F.col("_up"), F.col("_low"), F.col("median_h"))
    close = F.greatest(F.lit(K.SPLIT_MIN_CLOSE_X_PX), K.SPLIT_CLOSE_X_RATIO * F.greatest(F.col("_median_w"), F.lit(1.0)))
    tall = (F.col("_n") >= 2) & F.col("median_h").isNotNull() & (F.col("h") >= K.SPLIT_HEIGHT_RATIO * nearby)
    decision = (
        F.when(~F.coalesce(tall, F.lit(False)), "normal")
        .when(F.col("_low_dx") < -close, "skipped_far_left")
        .when(F.abs(F.col("_low_dx")) > close, "skipped_far_x")
        .otherwise("candidate")
    )
    parts = F.least(
        F.greatest(F.lit(2), F.rint(F.col("h") / F.col("median_h")).cast("int")), F.lit(max(2, K.SPLIT_MAX_PARTS))
    )
    return rows.withColumn("decision", decision).withColumn(
        "parts", F.when(F.col("decision") == "candidate", parts)
    ).drop("_median_w", "_up", "_low", "_low_dx", "_n")


# Picks per image ----------------------------------------------------------------------


def largest_box(boxes: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("box_id", "x1", "y1", "x2", "y2"), F.struct(G.area(_row()), -F.col("yc"), F.col("box_id")))
    return boxes.groupBy(*IMAGE).agg(best.alias("b")).select(*IMAGE, "b.*")


def top_boxes(boxes: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy(*IMAGE).orderBy(F.col("conf").desc(), "yc", "box_id")
    return boxes.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def _row() -> dict:
    return {name: F.col(name) for name in ("x1", "y1", "x2", "y2")}
