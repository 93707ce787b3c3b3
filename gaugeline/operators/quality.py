"""Checks on captures, runs and detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline import constants as K
from gaugeline.functions import boxes as G
from gaugeline.operators.boxes import FIELDS, IMAGE, robust_pitch, touching_runs


def capture_quality(boxes: DataFrame, regions: DataFrame, low: int, high: int, pitch_low: float, pitch_high: float) -> DataFrame:
    """One row per image with a verdict per rule; ``regions`` holds x0, y0, x1, y1 per image."""
    order = Window.partitionBy(*IMAGE).orderBy("yc", "box_id")
    inside = F.col("xc").between(F.col("x0"), F.col("x9")) & F.col("yc").between(F.col("y0"), F.col("y9"))
    region = regions.select("img", "x0", "y0", F.col("x1").alias("x9"), F.col("y1").alias("y9"))
    marked = boxes.join(region, "img").withColumns(
        {"_inside": inside, "_step": F.col("yc") - F.lag("yc").over(order)}
    )
    per_image = marked.groupBy(*IMAGE).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("_inside")).alias("outside"),
        F.count_if(F.col("_step") <= 0).alias("not_monotone"),
        F.collect_list(F.struct(*FIELDS)).alias("b"),
    )
    overlaps = lambda a, o: G.touching(a, o) & (o["box_id"] != a["box_id"]) & (G.overlap_over_smaller(a, o) > K.OVERLAP_LIMIT)
    heavy = F.exists(touching_runs(F.col("b")), lambda run: (F.size(run) > 1) & F.exists(run, lambda a: F.exists(run, lambda o: overlaps(a, o))))
    pitch = robust_pitch(boxes).select(*IMAGE, "pitch")
    judged = per_image.join(pitch, IMAGE).select(
        *IMAGE, "n",
        F.col("n").between(low, high).alias("count_ok"), (~heavy).alias("overlap_ok"), (F.col("not_monotone") == 0).alias("order_ok"),
        (F.col("outside") == 0).alias("region_ok"), F.coalesce(F.col("pitch").between(pitch_low, pitch_high), F.lit(False)).alias("pitch_ok"),
    )
    run = Window.partitionBy("run_id")
    both = (F.count(F.lit(1)).over(run) == 2) & (F.max("n").over(run) - F.min("n").over(run) <= 1)
    return judged.withColumn("pair_ok", both)


def run_parity(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float) -> DataFrame:
    """Where two results of the same runs differ by more than the tolerance."""
    left = a.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("in_a"))
    right = b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("in_b"))
    joined = left.join(right, keys, "full_outer")
    equal = F.lit(True)
    for v in values:
        equal = equal & F.coalesce(F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) <= tolerance, F.col(f"a_{v}").isNull() & F.col(f"b_{v}").isNull())
    verdict = F.when(F.col("in_a").isNull(), "only_b").when(F.col("in_b").isNull(), "only_a").when(equal, "equal").otherwise("differs")
    return joined.withColumn("verdict", verdict).drop("in_a", "in_b")


def parity_summary(parity: DataFrame) -> DataFrame:
    kinds = ("equal", "differs", "only_a", "only_b")
    return parity.groupBy("run_id").agg(*[F.count_if(F.col("verdict") == k).alias(k) for k in kinds])


def detector_diff(model: DataFrame, classical: DataFrame, reach: float = 0.5) -> DataFrame:
    """Each classical position against the nearest model box of its image.

    The nearest box is the closer of the last one above and the next one below, so no
    pairs are formed.  Missing: nothing within reach of the pitch; duplicate: another
    position chose the same box; misaligned: the numbers from the top differ.
    """
    order = Window.partitionBy(*IMAGE).orderBy("yc", "kind", "box_id")
    number = Window.partitionBy(*IMAGE, "kind").orderBy("yc", "box_id")
    both = model.select(*IMAGE, "box_id", "yc", F.lit(0).alias("kind")).unionByName(
        classical.select(*IMAGE, "box_id", "yc", F.lit(1).alias("kind"))
    ).withColumn("nr", F.row_number().over(number))
    box = F.when(F.col("kind") == 0, F.struct("yc", "box_id", "nr"))
    rows = both.withColumns(
        {
            "above": F.last(box, True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "below": F.first(box, True).over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).filter(F.col("kind") == 1)
    up, down = F.col("yc") - F.col("above")["yc"], F.col("below")["yc"] - F.col("yc")
    nearest = F.when(F.col("below").isNull() | (up <= down), F.col("above")).otherwise(F.col("below"))
    pitch = robust_pitch(model).select(*IMAGE, "pitch")
    rows = rows.withColumn("nearest", nearest).join(pitch, IMAGE, "left")
    close = F.abs(F.col("nearest")["yc"] - F.col("yc")) <= reach * F.col("pitch")
    rows = rows.withColumn("hit", F.when(close, F.col("nearest")))
    shared = Window.partitionBy(*IMAGE, F.col("hit")["box_id"])
    verdict = (
        F.when(F.col("hit").isNull(), "missing").when(F.count(F.lit(1)).over(shared) > 1, "duplicate")
        .when(F.col("hit")["nr"] != F.col("nr"), "misaligned").otherwise("aligned")
    )
    return rows.withColumn("verdict", verdict).select(*IMAGE, "box_id", F.col("hit")["box_id"].alias("model_box"), "verdict")
