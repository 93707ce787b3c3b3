"""Pairing the items of both sides of a run.

All steps of a run share one partitioning by run_id.  A run holds the items of two
images, so its groups are small; runs are independent of each other.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline import constants as K
from gaugeline.functions.arrays import positive_median
from gaugeline.functions.scalars import observations, positive
from gaugeline.operators import pairing

SIDE = ["run_id", "side"]
CARRIED = ["id", "tube_idx", "distance_in", "relative_position", "notes", "unmatched"]
HEADER = ["bounds_top", "bounds_bottom", "detection_source", "model_block"]


def by_run(items: DataFrame) -> DataFrame:
    """One exchange for everything that follows."""
    return items.repartition("run_id")


def active_order(items: DataFrame) -> DataFrame:
    """Active items with their place from the top: by y when all have one, else as listed."""
    side = Window.partitionBy(*SIDE)
    rows = items.filter("active").withColumn("has_y", F.bool_and(F.col("y_center").isNotNull()).over(side))
    listed = Window.partitionBy(*SIDE).orderBy(
        F.when(F.col("has_y"), F.col("y_center")), F.when(~F.col("has_y"), F.col("source_order")), "tube_idx", "id"
    )
    return rows.withColumn("place", F.row_number().over(listed))


def slot_increment(gap: Column, lower_height: Column, upper_height: Column, pitch: Column) -> Column:
    """How many slots one gap spans; clearly missing objects only."""
    local = 1.05 * positive_median(F.array_compact(F.array(lower_height, upper_height)))
    expected = F.when(pitch > 1e-6, F.greatest(local, pitch)).otherwise(local)
    ratio = F.abs(gap) / F.when(expected > 1e-6, expected)
    return F.when(ratio >= K.SLOT_RATIO_LIMIT, F.greatest(F.lit(1), F.rint(ratio).cast("int"))).otherwise(F.lit(1))


def with_pitch(ordered: DataFrame) -> DataFrame:
    """Adds the typical gap of the side, null where it cannot be told."""
    side = Window.partitionBy(*SIDE)
    down = side.orderBy("place")
    rows = ordered.withColumn("_gap", F.when(F.col("has_y"), F.abs(F.col("y_center") - F.lag("y_center").over(down))))
    rows = rows.withColumn("_raw", F.median(positive(F.col("_gap"))).over(side))
    central = F.col("_gap").between(0.45 * F.col("_raw"), 1.85 * F.col("_raw"))
    rows = rows.withColumn("_central", F.median(positive(F.when(central, F.col("_gap")))).over(side))
    return rows.withColumn("pitch", F.coalesce("_central", "_raw")).drop("_gap", "_raw", "_central")


def mark_attached(rows: DataFrame, slot: str, order: Column) -> DataFrame:
    """Adds ``attached``: false for top items that stand four or more slots above the rest."""
    upward = Window.partitionBy(*SIDE).orderBy(slot, order)
    side = Window.partitionBy(*SIDE)
    step = F.col(slot) - F.lag(slot).over(upward)
    marked = rows.withColumns({"_at": F.row_number().over(upward), "_step": step})
    anchored = F.when(F.col("_step").isNull() | (F.col("_step") < K.DETACHED_TOP_GAP), F.col("_at"))
    return marked.withColumn("_last", F.max(anchored).over(side)).withColumn("attached", F.col("_at") <= F.col("_last")).drop(
        "_at", "_step", "_last"
    )


def vertical_slots(ordered: DataFrame) -> DataFrame:
    """Slots counted from the bottom up; items without y keep their list position."""
    return _with_vertical(ordered).filter("attached").drop("attached")


def _with_vertical(ordered: DataFrame) -> DataFrame:
    rows = with_pitch(ordered)
    upward = Window.partitionBy(*SIDE).orderBy(F.col("y_center").desc(), "place")
    span = slot_increment(
        F.lag("y_center").over(upward) - F.col("y_center"), F.lag("box_height").over(upward), F.col("box_height"), F.col("pitch")
    )
    rows = rows.withColumn("_step", F.when(F.lag("place").over(upward).isNull(), 1).otherwise(span))
    usable = F.col("has_y") & (F.coalesce(F.col("pitch"), F.lit(0.0)) > 1e-6)
    counted = F.sum("_step").over(upward)
    rows = rows.withColumn("slot", F.when(usable, counted).otherwise(F.col("place")).cast("int"))
    return mark_attached(rows.drop("_step"), "slot", F.col("place").desc())


def _told(datasets: DataFrame) -> Column:
    """Whether a set says that its side is modelled: by its source, or by a model block in its metadata."""
    told = [F.coalesce(F.col(name) == value, F.lit(False)) for name, value in (("detection_source", K.MODEL_SOURCE), ("model_block", True)) if name in datasets.columns]
    return reduce(or_, told, F.lit(False))


def run_bounds(datasets: DataFrame) -> DataFrame:
    """One row per run with the bounds of both sides, so that a join with it keeps the partitioning by run."""
    interval, told = F.struct("bounds_top", "bounds_bottom"), _told(datasets)
    of = lambda side, value: F.when(F.col("side") == side, value)
    return datasets.groupBy("run_id").agg(
        *[F.max(of(s, interval)).alias(f"_{s}") for s in ("151", "152")], *[F.coalesce(F.bool_or(of(s, told)), F.lit(False)).alias(f"told{s}") for s in ("151", "152")]
    )


def bundle_slots(ordered: DataFrame, datasets: DataFrame) -> DataFrame:
    """Slots from the position between the bounds of the bundle; none without bounds."""
    bounds = run_bounds(datasets).drop("told151", "told152")
    return _with_bundle(ordered.join(bounds, "run_id", "left")).filter("attached").drop("attached")


def _with_bundle(rows: DataFrame) -> DataFrame:
    """Rows of a side without bounds or pitch have no slot and are not attached."""
    side = Window.partitionBy(*SIDE)
    own = F.when(F.col("side") == "151", F.col("_151")).otherwise(F.col("_152"))
    top, bottom = own["bounds_top"], own["bounds_bottom"]
    tall = F.when(bottom - top > 1e-6, bottom - top)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (bottom - F.col("y_center")) / tall))
    rows = rows.withColumn("share", share).drop("_151", "_152")
    rows = rows.withColumn("_whole", F.bool_and(F.col("share").isNotNull()).over(side))
    upward = side.orderBy("share", "place")
    rows = rows.withColumn("_gap", positive(F.col("share") - F.lag("share").over(upward)))
    rows = rows.withColumn("_raw", F.median("_gap").over(side))
    central = F.col("_gap").between(0.35 * F.col("_raw"), 2.25 * F.col("_raw"))
    rows = rows.withColumn("_central", F.median(F.when(central, F.col("_gap"))).over(side))
    pitch = F.coalesce("_central", "_raw")
    rows = rows.withColumn("pitch_norm", F.when(F.col("_whole") & (pitch > 1e-6), pitch))
    # both tests hold for a whole side or for none of it
    slot = F.greatest(F.lit(1), F.rint(F.col("share") / F.col("pitch_norm")).cast("int") + 1)
    rows = rows.withColumn("slot", F.when(F.col("pitch_norm").isNotNull(), slot))
    marked = mark_attached(rows.drop("_whole", "_gap", "_raw", "_central"), "slot", F.col("place"))
    return marked.withColumn("attached", F.col("attached") & F.col("slot").isNotNull())


def best_slot_offset(slots: DataFrame) -> DataFrame:
    """Per run, the shift of the right slots that fits the left slots best."""
    sets = slots.groupBy("run_id").agg(
        F.collect_set(F.when(F.col("side") == "151", F.col("slot"))).alias("l"),
        F.collect_set(F.when(F.col("side") == "152", F.col("slot"))).alias("r"),
    )
    return sets.select("run_id", slot_offset(F.col("l"), F.col("r")).alias("offset"))


def slot_offset(left: Column, right: Column) -> Column:
    """The shift of the right set of slots that fits the left one best."""
    shifts = sorted({*K.SLOT_OFFSETS, K.RIGHT_SLOT_HINT - 1, K.RIGHT_SLOT_HINT, K.RIGHT_SLOT_HINT + 1})

    def score(shift: int) -> Column:
        moved = F.transform(right, lambda s: s + shift)
        outside = F.size(F.filter(moved, lambda s: (s > F.array_max(left)) | (s < F.array_min(left))))
        differ = F.size(F.array_except(left, moved)) + F.size(F.array_except(moved, left))
        return F.struct(
            F.size(F.array_intersect(left, moved)).alias("matched"),
            (-differ).alias("differ"),
            (-outside).alias("outside"),
            F.lit(-abs(shift)).alias("near"),
            F.lit(int(shift == 0)).alias("zero"),
            F.lit(-shift).alias("first"),
        )

    best = F.array_max(F.array(*[score(s) for s in shifts]))
    known = (F.size(left) > 0) & (F.size(right) > 0)
    return F.when(known, -best["first"]).otherwise(F.lit(0))


def _pair_rows(paired: DataFrame, order: list, *others: str) -> DataFrame:
    """Rows (l, r, status) of a run to match rows with running numbers."""
    number = F.row_number().over(Window.partitionBy("run_id").orderBy(*order))
    left, right = F.col("l"), F.col("r")
    return paired.withColumn("tube_number", number).select(
        "run_id", "tube_number", F.col("status").alias("match_status"),
        left["id"].alias("id_151"), right["id"].alias("id_152"),
        left["tube_idx"].alias("tube_idx_151"), left["distance_in"].alias("measurement_151"),
        right["tube_idx"].alias("tube_idx_152"), right["distance_in"].alias("measurement_152"),
        right["relative_position"].alias("r152_position"),
        observations(F.col("status"), left["notes"], right["notes"]).alias("observations"),
        *others,
    )


def _sides(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Brings the left and the right item of a key into one row."""
    item = F.struct(*CARRIED)
    return rows.groupBy(*keys).agg(
        F.max(F.when(F.col("side") == "151", item)).alias("l"), F.max(F.when(F.col("side") == "152", item)).alias("r")
    )


def in_line(slots: DataFrame, queue: str = "queue") -> DataFrame:
    """Adds turn, phase and alone: with the slot, the place of an item in the pairing by slots."""
    line = Window.partitionBy(*SIDE, "slot").orderBy(queue, "id")
    plain = F.sum(F.when(F.col("unmatched"), 0).otherwise(1)).over(line)
    return slots.withColumns(
        {
            "turn": plain + F.when(F.col("unmatched"), 1).otherwise(0),
            "phase": F.when(~F.col("unmatched"), 2).when(F.col("side") == "151", 0).otherwise(1),
            "alone": F.when(F.col("unmatched"), F.row_number().over(line)).otherwise(0),
        }
    )


def _slot_status() -> Column:
    return (
        F.when(F.col("phase") == 0, "left_only_manual").when(F.col("phase") == 1, "right_only_manual")
        .when(F.col("l").isNotNull() & F.col("r").isNotNull(), "matched")
        .when(F.col("l").isNotNull(), "left_only").otherwise("right_only")
    )


def _order_status() -> Column:
    left_alone = F.coalesce(F.col("l")["unmatched"], F.lit(False))
    right_alone = F.coalesce(F.col("r")["unmatched"], F.lit(False)) & ~left_alone
    return (
        F.when(left_alone, "left_only_manual").when(right_alone, "right_only_manual")
        .when(F.col("l").isNotNull() & F.col("r").isNotNull(), "matched")
        .when(F.col("l").isNotNull(), "left_only").otherwise("right_only")
    )


def _without_partner(rows: DataFrame) -> DataFrame:
    return rows.withColumn("r", F.when(F.col("status") != "left_only_manual", F.col("r"))).withColumn(
        "l", F.when(F.col("status") != "right_only_manual", F.col("l"))
    )


def slot_match(slots: DataFrame, queue: str = "queue") -> DataFrame:
    """Full outer pairing by slot; items marked unmatched stand alone, their partner stays."""
    offsets = best_slot_offset(slots)
    shifted = slots.join(offsets, "run_id").withColumn(
        "slot", F.col("slot") + F.when(F.col("side") == "152", F.col("offset")).otherwise(0)
    )
    paired = _sides(in_line(shifted, queue), ["run_id", "slot", "turn", "phase", "alone"])
    return _pair_rows(paired.withColumn("status", _slot_status()), [F.col("slot").desc(), "turn", "phase", "alone"])


def order_match(ordered: DataFrame) -> DataFrame:
    """k-th with k-th; an item marked unmatched also takes its partner out of the result."""
    paired = _sides(ordered, ["run_id", "place"])
    return _pair_rows(_without_partner(paired.withColumn("status", _order_status())), ["place"])


def _with_slots(ordered: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds slot, queue and bundle: bundle slots for runs where both sides have them, else vertical slots; null for items without.

    Both kinds are columns of the same rows, so that a run is read and dealt once.
    """
    rows = _with_vertical(ordered).withColumns({"v_slot": F.when(F.col("attached"), F.col("slot"))}).drop("slot", "attached", "pitch")
    rows = _with_bundle(rows.join(bounds, "run_id", "left"))
    run = Window.partitionBy("run_id")
    has = lambda side: F.max(F.when(F.col("attached") & (F.col("side") == side), 1).otherwise(0)).over(run)
    rows = rows.withColumn("bundle", has("151") + has("152") == 2)
    slot = F.when(F.col("bundle"), F.when(F.col("attached"), F.col("slot"))).otherwise(F.col("v_slot"))
    queue = F.when(F.col("bundle"), F.col("place")).otherwise(-F.col("place"))
    return rows.withColumns({"slot": slot, "queue": queue}).drop("v_slot", "attached", "share", "pitch_norm")


def chosen_slots(ordered: DataFrame, datasets: DataFrame) -> DataFrame:
    """Bundle slots for runs where both sides have them, else vertical slots."""
    rows = _with_slots(ordered, run_bounds(datasets).drop("told151", "told152")).filter(F.col("slot").isNotNull())
    return rows.select(*SIDE, "slot", "queue", *CARRIED, "bundle")


def _match_input(items: DataFrame, datasets: DataFrame | None) -> DataFrame:
    """Items with the bounds of their side and whether it is modelled; the rows of a run are neighbours."""
    rows = by_run(items)
    if datasets is None:
        top, bottom, told = F.col("bounds_top"), F.col("bounds_bottom"), _told(items)
    else:
        rows = rows.join(run_bounds(datasets), "run_id", "left")
        own = lambda name: F.when(F.col("side") == "151", F.col(f"{name}151")).otherwise(F.col(f"{name}152"))
        top, bottom, told = own("_")["bounds_top"], own("_")["bounds_bottom"], own("told")
    model = F.col("model_source") if "model_source" in items.columns else F.lit(False)
    given = {"top": top.cast("double"), "bottom": bottom.cast("double"), "told": told, "model_source": model}
    return rows.select(*[given[c].alias(c) if c in given else c for c in pairing.ITEM]).sortWithinPartitions("run_id")


def match_runs(items: DataFrame, datasets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The full match: (match rows with their strategy, one header row per run).

    Without ``datasets`` every item carries the header of its set (bounds_top, bounds_bottom, and detection_source or model_block).
    What both variants of a run would match is counted; the chosen one is then carried out. A side is also modelled by the source of
    any of its items, active or not. A run without active items is matched too, to no rows.
    """
    rows = _match_input(items, datasets)
    kinds = dict(rows.dtypes)
    matched = {
        "run_id": kinds["run_id"], "tube_number": "int", "match_status": "string", "id_151": kinds["id"], "id_152": kinds["id"], "tube_idx_151": kinds["tube_idx"],
        "measurement_151": kinds["distance_in"], "tube_idx_152": kinds["tube_idx"], "measurement_152": kinds["distance_in"], "r152_position": kinds["relative_position"],
        "notes_151": kinds["notes"], "notes_152": kinds["notes"], "strategy": "string",
    }
    header = {
        "run_id": kinds["run_id"], **{c: "bigint" for c in ("n151", "n152", "slot_matched", "order_matched")}, "bundle": "boolean", "count_ratio": "double", "strategy": "string",
    }
    found, headers = (rows.mapInArrow(pairing.matcher(part, list(kind)), ", ".join(f"{c} {t}" for c, t in kind.items())) for part, kind in enumerate((matched, header)))
    noted = observations(F.col("match_status"), F.col("notes_151"), F.col("notes_152")).alias("observations")
    return found.select(*[c for c in matched if c not in ("notes_151", "notes_152", "strategy")], noted, "strategy"), headers


def match_summary(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Counts per run of match states and of items set aside by hand."""
    states = rows.groupBy("run_id").agg(
        F.count_if(F.col("match_status") == "matched").alias("matched"),
        F.count_if(F.col("match_status").isin("left_only", "left_only_manual")).alias("left_only"),
        F.count_if(F.col("match_status").isin("right_only", "right_only_manual")).alias("right_only"),
    )
    aside = lambda side, test: F.count_if((F.col("side") == side) & test)
    hand = items.groupBy("run_id").agg(
        aside("151", ~F.col("active")).alias("inactive_151"), aside("152", ~F.col("active")).alias("inactive_152"),
        aside("151", F.col("active") & F.col("unmatched")).alias("manual_unmatched_151"),
        aside("152", F.col("active") & F.col("unmatched")).alias("manual_unmatched_152"),
    )
    numbers = [c for c in (*states.columns, *hand.columns) if c != "run_id"]
    return hand.join(states, "run_id", "left").select("run_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])


def audit_rows(items: DataFrame) -> DataFrame:
    """Items of both sides as one audit table."""
    columns = ["run_id", "id", "tube_idx", "distance_in", "relative_position", "active", "unmatched", "notes"]
    side = lambda s: items.filter(F.col("side") == s).select(F.lit(s).alias("side"), *columns)
    return side("151").unionByName(side("152"))


def bundle_bounds(candidates: Column) -> Column:
    """First usable interval of an ordered array of (top, bottom) candidates."""
    tidy = F.transform(
        candidates,
        lambda c: F.struct(F.least(c["top"], c["bottom"]).alias("low"), F.greatest(c["top"], c["bottom"]).alias("high")),
    )
    usable = F.filter(tidy, lambda c: c["high"] > c["low"] + 1e-6)
    return F.get(usable, 0)


def bottom_anchor(datasets: DataFrame, items: DataFrame) -> DataFrame:
    """Bottom y per side: from the region, else the image height, else the lowest item."""
    lowest = with_pitch(active_order(items)).groupBy(*SIDE).agg(
        (F.max("y_center") + 0.5 * F.coalesce(F.first("pitch"), F.lit(0.0))).alias("lowest")
    )
    return datasets.join(lowest, SIDE, "left").select(
        *SIDE, F.coalesce(F.col("roi_y") + F.col("roi_h"), F.col("image_h"), F.col("lowest")).alias("anchor_y")
    )


def reconcile_edits(items: DataFrame, edits: DataFrame) -> DataFrame:
    """Merged items, with an error where an edit is unknown, repeated or missing."""
    counted = edits.groupBy("run_id", "side", "id").agg(
        F.count(F.lit(1)).alias("times"),
        *[F.max(c).alias(f"e_{c}") for c in ("active", "unmatched", "notes", "relative_position")],
    )
    both = items.withColumn("known", F.lit(True)).join(counted, ["run_id", "side", "id"], "full_outer")
    error = (
        F.when(F.col("known").isNull(), "unknown").when(F.col("times").isNull(), "missing").when(F.col("times") > 1, "repeated")
    )
    given = F.lower(F.trim(F.coalesce(F.nullif(F.col("e_relative_position"), F.lit("")), F.col("relative_position"))))
    place = F.when(given.isin("before", "after"), given).otherwise(F.coalesce("relative_position", F.lit("after")))
    notes = F.coalesce(F.nullif(F.col("e_notes"), F.lit("")), F.col("notes"), F.lit(""))
    return both.select(
        "run_id", "side", "id",
        F.coalesce("e_active", "active").alias("active"), F.coalesce("e_unmatched", "unmatched").alias("unmatched"),
        F.substring(F.trim(notes), 1, 200).alias("notes"),
        F.when(F.col("side") == "152", place).alias("relative_position"),
        error.alias("error"),
    )


def manual_compare(points: DataFrame, sides: DataFrame, algorithm: DataFrame) -> DataFrame:
    """Clicked points against measured items, by tube number.

    ``sides`` has one row per run: the two-point line, constant x and scale of each side
    (columns with suffix _151 / _152).  The last item of a tube number in ``algorithm`` counts.
    """
    from gaugeline.functions.scalars import residual_left, residual_right, total_length
    from gaugeline.operators.measure import x_on_line

    rows = points.join(sides, "run_id", "left")

    def ref(side: str) -> Column:
        line = [F.col(f"{c}_{side}") for c in ("lx0", "ly0", "lx1", "ly1")]
        on_line = x_on_line(*line, F.col(f"y_{side}"))
        return F.when(line[0].isNotNull() & F.col(f"y_{side}").isNotNull(), on_line).otherwise(F.col(f"const_x_{side}"))

    for side in ("151", "152"):
        scale = F.nullif(F.col(f"px_per_in_{side}"), F.lit(0.0))
        rows = rows.withColumn(f"ref_{side}", ref(side)).withColumn(
            f"manual_{side}", F.abs(F.col(f"x_{side}") - F.col(f"ref_{side}")) / scale
        )
        last = F.max_by(F.struct("distance_in", "relative_position"), "source_order")  # of a repeated number
        numbers = algorithm.filter(F.col("side") == side).groupBy("run_id", F.col("tube_idx").alias("tube_number")).agg(last.alias("i")).select(
            "run_id", "tube_number", F.col("i.distance_in").alias(f"algorithm_{side}"), F.col("i.relative_position").alias(f"position_{side}"),
        )
        rows = rows.join(numbers, ["run_id", "tube_number"], "left")
    rows = rows.withColumn(
        "manual_position_152",
        F.when(F.col("x_152") < F.col("ref_152"), "before").when(F.col("x_152").isNotNull() & F.col("ref_152").isNotNull(), "after"),
    )
    manual = total_length(residual_left(F.col("manual_151")), residual_right(F.col("manual_152"), F.col("manual_position_152")))
    algo = total_length(residual_left(F.col("algorithm_151")), residual_right(F.col("algorithm_152"), F.col("position_152")))
    complete = F.col("x_151").isNotNull() & F.col("x_152").isNotNull()
    return rows.select(
        "run_id", "tube_number", F.when(complete, "complete").otherwise("partial").alias("status"),
        "manual_151", "algorithm_151", (F.col("manual_151") - F.col("algorithm_151")).alias("delta_151"),
        "manual_152", "algorithm_152", (F.col("manual_152") - F.col("algorithm_152")).alias("delta_152"),
        "manual_position_152", manual.alias("manual_total"), algo.alias("algorithm_total"), (manual - algo).alias("delta_total"),
    )


def viewer_positions(items: DataFrame, datasets: DataFrame) -> DataFrame:
    """Where an item is drawn: given positions less the crop origin, else evenly spaced."""
    side = Window.partitionBy(*SIDE)
    listed = side.orderBy("source_order", "tube_idx", "id")
    rows = items.join(datasets.select(*SIDE, "image_w", "image_h", "roi_x", "roi_y", "roi_w", "roi_h"), SIDE)
    w, h = F.col("image_w"), F.col("image_h")
    cropped = (F.abs(F.col("roi_w") - w) <= 2.0) & (F.abs(F.col("roi_h") - h) <= 2.0) & F.col("roi_x").isNotNull() & F.col("roi_y").isNotNull()
    left = F.when(F.coalesce(cropped, F.lit(False)), F.col("roi_x")).otherwise(0.0)
    top = F.when(F.coalesce(cropped, F.lit(False)), F.col("roi_y")).otherwise(0.0)
    rows = rows.withColumns({"_at": F.row_number().over(listed) - 1, "_n": F.count(F.lit(1)).over(side)})
    pad = F.greatest(F.lit(42.0), h * 0.07)
    step = (h - pad - pad) / F.greatest(F.col("_n") - 1, F.lit(1))
    spaced = F.when(F.col("_n") == 1, 0.5 * h).otherwise(h - pad - F.col("_at") * step)
    x = F.coalesce(F.coalesce("x_raw", "x_start", "x_smooth", "ref_x") - left, 0.5 * w)
    y = F.coalesce(F.col("y_center") - top, spaced)
    keep = lambda v, size: F.greatest(F.lit(18.0), F.least(F.greatest(F.lit(18.0), size - 18.0), v))
    return rows.select(
        *SIDE, "id", F.bround(keep(x, w), 3).alias("x"), F.bround(keep(y, h), 3).alias("y"), (F.col("ref_x") - left).alias("ref_x")
    )
