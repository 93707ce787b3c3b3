"""Filling gaps of a stack from weak boxes, splitting tall boxes, and the whole chain.

Each step of a recovery sees what the steps before it added, so it goes through the targets of an image in turn.  An image is
one row with arrays of boxes; the steps of a chain run one after the other on batches of such rows (``stacks``), and nothing is
unpacked, dealt or sorted in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline import constants as K
from gaugeline.operators import boxes as B
from gaugeline.operators import stacks
from gaugeline.operators.boxes import FIELDS, IMAGE

BOX_TYPE = (
    "struct<yc:double,box_id:string,xc:double,w:double,h:double,x1:double,y1:double,"
    "x2:double,y2:double,conf:double,flags:array<string>>"
)
NO_BOXES = f"array<{BOX_TYPE}>"

CLEAN: list[stacks.Step] = [("dedupe", {}), ("clusters", {})]
GAPS: list[stacks.Step] = [("gaps", {})]
EDGES: list[stacks.Step] = [("edges", {})]
UNION: list[stacks.Step] = [("union", {})]


def empty() -> Column:
    return F.array().cast(NO_BOXES)


def run_steps(rows: DataFrame, steps: list[stacks.Step], *outputs: str) -> DataFrame:
    """Rows of images after the steps: the arrays ``outputs`` are replaced or added; kept boxes are ordered as an array of boxes sorts."""
    names = [*rows.columns, *[c for c in outputs if c not in rows.columns]]
    fields = dict(rows.dtypes) | {c: NO_BOXES for c in outputs}
    return rows.mapInArrow(stacks.chain(steps, outputs, names), ", ".join(f"`{c}` {fields[c]}" for c in names))


def recovery_input(kept: DataFrame, weak: DataFrame, images: DataFrame) -> DataFrame:
    """One row per image: kept boxes (sorted), weak boxes, image size and bounds.

    All three sides are grouped by the image keys before they are joined, so the kept
    boxes keep the partitioning they come with and no box pairs are formed.  ``images``
    may be keyed by the image alone, at the price of one more exchange.
    """
    gathered = F.array_sort(F.collect_list(F.struct(*FIELDS)))
    rows = kept.groupBy(*IMAGE).agg(gathered.alias("kept")).join(weak.groupBy(*IMAGE).agg(gathered.alias("weak")), IMAGE, "left")
    keys = IMAGE if set(IMAGE) <= set(images.columns) else ["img"]
    sizes = images.select(
        *keys, F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), "bounds_top", "bounds_bottom"
    )
    return rows.withColumn("weak", F.coalesce("weak", empty())).join(sizes, keys)


def recover_gaps(rows: DataFrame) -> DataFrame:
    """Adds the array ``found``: boxes recovered between the kept ones."""
    return run_steps(rows, GAPS, "found")


def recover_edges(rows: DataFrame) -> DataFrame:
    """Adds the array ``found``: boxes recovered above and below the kept ones."""
    return run_steps(rows, EDGES, "found")


def union_recovered(rows: DataFrame) -> DataFrame:
    """Suppress again where boxes were added; other images stay as they are."""
    return run_steps(rows, UNION, "kept").drop("found")


def split_oversize(boxes: DataFrame, separators: DataFrame, height: float = float("inf")) -> DataFrame:
    """Cut candidates at their separators (image keys, box_id, seps: sorted array of y).

    Parts end at the borders of the image.  Too few separators or a part under 0.35 of the median height keep the box whole.  The
    separators of an image travel as one row, so the boxes stay partitioned by image.
    """
    packed = B.pack(boxes, "kept").join(listed(separators), IMAGE, "left")
    rows = run_steps(packed, [("cuts", {}), ("split", {"height": height})], "kept", "found")
    every = lambda c, split: F.transform(c, lambda b: F.struct(F.lit(split).alias("was_split"), b.alias("b")))
    shown = B.explode_boxes(rows, F.concat(every("kept", False), every("found", True)))
    return shown.select(*IMAGE, "b.was_split", "b.b.*")


def listed(separators: DataFrame) -> DataFrame:
    return separators.groupBy(*IMAGE).agg(F.collect_list(F.struct("box_id", "seps")).alias("cuts"))


def clean_steps(base_conf: float, recover: bool, cuts: dict | None, height: float) -> list[stacks.Step]:
    """The fixed order of the cleaning; ``cuts`` tells where separators come from, null without any."""
    split = [("cuts", cuts)] if cuts is not None else []
    steps = split + CLEAN
    if recover:
        steps = steps + GAPS + UNION + EDGES + UNION
    steps = steps + [("lateral", {"base_conf": base_conf})]
    return steps + [("split", {"height": height}), *UNION] if split else steps


def clean_rows(rows: DataFrame, base_conf: float = K.DETECTOR_CONF, recover: bool = True, cuts: dict | None = None, height: float = float("inf")) -> DataFrame:
    """The whole cleaning of rows of images: ``kept`` holds the detector's boxes before, and the clean ones after; they are numbered."""
    cleaned = run_steps(rows, clean_steps(base_conf, recover, cuts, height), "kept")  # ordered by yc and name
    numbered = cleaned.select(*IMAGE, F.size("kept").alias("_n"), F.posexplode("kept").alias("_at", "b"))
    return numbered.select(*IMAGE, "b.*", (F.col("_at") + 1).alias("tube_idx"), (F.col("_n") - F.col("_at")).alias("from_bottom"))


def clean_boxes(
    boxes: DataFrame,
    weak: DataFrame,
    images: DataFrame,
    spacing: DataFrame | None = None,
    separators: DataFrame | None = None,
    base_conf: float = K.DETECTOR_CONF,
    recover: bool = True,
    height: float = float("inf"),
) -> DataFrame:
    """The whole cleaning of detector boxes, in its fixed order.

    Suppress, drop isolated clusters, recover gaps and edges (suppressing again where
    boxes were added), drop lateral outliers, split tall boxes, number from the top.
    """
    rows = recovery_input(boxes, weak, images) if recover else B.pack(boxes, "kept")
    if spacing is not None:
        known = spacing.filter((F.col("median_gap_px") > 1e-6) & (F.col("allowed_gap_px") > 1e-6))
        rows = rows.join(F.broadcast(known.select("side", "allowed_gap_px")), "side", "left")
    if separators is not None:
        rows = rows.join(listed(separators), IMAGE, "left")
    return clean_rows(rows, base_conf, recover, None if separators is None else {}, height)
