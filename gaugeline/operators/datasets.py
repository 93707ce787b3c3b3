"""Annotation pools: joins of images, labels and flags, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.ranking import hash_rank
from gaugeline.operators.measure import fixed6, rebase_line
from gaugeline.session import broadcast_if_small


def stem_of(path: Column) -> Column:
    """Relative path without its suffix, with plain separators."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"\.[A-Za-z0-9]+$", "")


def image_tally(images: DataFrame, labels: DataFrame, predictions: DataFrame, flags: DataFrame, task: str) -> DataFrame:
    """One row per image: counts, whether it is labelled, negative or bad."""
    marks = flags.groupBy(stem_of(F.col("rel_path")).alias("stem")).agg(
        F.coalesce(F.bool_or((F.col("flag") == "negative") & (F.col("task") == task) & F.col("value")), F.lit(False)).alias("negative"),
        F.coalesce(F.bool_or((F.col("flag") == "bad_warp") & F.col("value")), F.lit(False)).alias("bad_warp"),
    )
    rows = images.join(labels.select("stem", "box_count"), "stem", "left").join(
        predictions.select("stem", "prediction_count"), "stem", "left"
    ).join(marks, "stem", "left")
    filled = rows.fillna({"box_count": 0, "prediction_count": 0}).fillna({"negative": False, "bad_warp": False})
    return filled.withColumn("labeled", (F.col("box_count") > 0) | F.col("negative")).withColumn(
        "has_predictions", F.col("prediction_count") > 0
    )


def label_image_join(images: DataFrame, labels: DataFrame, missing: str = "error", require_boxes: bool = False) -> DataFrame:
    """Images with their labels; ``missing`` is error, background or drop."""
    rows = images.join(labels, "stem", "left")
    if require_boxes:
        return rows.filter(F.col("box_count") > 0).withColumn("error", F.lit(None).cast("string"))
    if missing == "drop":
        return rows.filter(F.col("box_count").isNotNull()).withColumn("error", F.lit(None).cast("string"))
    error = F.when(F.col("box_count").isNull(), "missing_label") if missing == "error" else F.lit(None).cast("string")
    return rows.withColumn("error", error)


def unlabeled_images(images: DataFrame, labels: DataFrame, camera: str | None = None, include_labeled: bool = False) -> DataFrame:
    rows = images if camera is None else images.filter(F.col("camera") == camera)
    return rows if include_labeled else rows.join(labels.filter(F.col("box_count") > 0), "stem", "left_anti")


def drop_bad_images(images: DataFrame, flags: DataFrame, by: str = "path") -> DataFrame:
    """Without the images flagged bad, by exact path or by stem with any suffix."""
    bad = flags.filter((F.col("flag") == "bad_warp") & F.col("value")).select(F.translate("rel_path", "\\", "/").alias("rel_path"))
    if by == "path":
        return images.join(bad, "rel_path", "left_anti")
    return images.join(bad.select(stem_of(F.col("rel_path")).alias("stem")), "stem", "left_anti")


def training_samples(
    images: DataFrame, labels: DataFrame, flags: DataFrame, task: str, camera: str | None = None, include_unlabeled: bool = False
) -> DataFrame:
    """Positives and explicit negatives of a task (or all images), without bad ones."""
    pool = drop_bad_images(images if camera is None else images.filter(F.col("camera") == camera), flags, "stem")
    pool = pool.join(labels.select("stem", "box_count"), "stem", "left")
    if include_unlabeled:
        return pool.fillna({"box_count": 0})
    negative = flags.filter((F.col("flag") == "negative") & (F.col("task") == task) & F.col("value")).select(
        stem_of(F.col("rel_path")).alias("stem"), F.lit(True).alias("negative")
    ).distinct()
    labelled = pool.filter(F.col("box_count").isNotNull()).join(negative, "stem", "left")
    return labelled.filter((F.col("box_count") > 0) | F.coalesce("negative", F.lit(False))).drop("negative")


def split_three(samples: DataFrame, train: float, val: float, test: float, seed: int, key: str = "stem") -> DataFrame:
    """Train, val and test by ratio, in a seeded order; sizes are floors, test takes the rest."""
    if abs(train + val + test - 1.0) > 1e-9:
        raise ValueError(f"split ratios must add up to 1.0, not {train + val + test}")
    ranked = hash_rank(samples, key, seed, [])
    end = F.floor(F.col("total") * F.lit(train))
    split = F.when(F.col("rank") <= end, "train").when(F.col("rank") <= end + F.floor(F.col("total") * F.lit(val)), "val").otherwise("test")
    return ranked.withColumn("split", split).drop("rank", "total")


def split_train_val(samples: DataFrame, seed: int = 42, ratio: float = 0.2, small: int = 8, key: str = "stem") -> DataFrame:
    """Train and val; below eight samples both get all of them."""
    ranked = hash_rank(samples, key, seed, [])
    val = F.greatest(F.lit(1.0), F.rint(F.col("total") * F.lit(ratio)))
    sets = F.when(F.col("total") < small, F.array(F.lit("train"), F.lit("val"))).when(
        F.col("rank") <= val, F.array(F.lit("val"))
    ).otherwise(F.array(F.lit("train")))
    return ranked.withColumn("split", F.explode(sets)).drop("rank", "total")


def positive_split(samples: DataFrame, ratio: float, seed: int, key: str = "stem") -> DataFrame:
    """Val takes a share from eight samples up, else all of them."""
    ranked = hash_rank(samples, key, seed, [])
    val = F.when(F.col("total") >= 8, F.greatest(F.lit(1.0), F.rint(F.col("total") * F.lit(ratio)))).otherwise(F.col("total"))
    return ranked.withColumn("split", F.when(F.col("rank") <= val, "val").otherwise("train")).drop("rank", "total")


def limited_negatives(negatives: DataFrame, n_train: int, n_val: int, seed: int) -> DataFrame:
    """Round robin over cameras until both quotas are full, val first.

    A row's place in the draw follows from its rank in its camera and the sizes of all
    cameras, so nothing is sorted or limited as a whole.
    """
    ranked = hash_rank(negatives, "stem", seed, ["camera"])
    sizes = ranked.groupBy("camera").agg(F.count(F.lit(1)).alias("n"))
    every = broadcast_if_small(sizes.agg(F.sort_array(F.collect_list(F.struct("camera", "n"))).alias("cameras")).withColumn("_all", F.lit(1)))

    def place(turn: Column, left) -> Column:
        """Rows drawn up to this one, when each camera has ``left`` of its size."""
        own = F.col("camera")
        return F.aggregate("cameras", F.lit(0).cast("bigint"), lambda a, c: a + F.greatest(F.lit(0), F.least(left(c), turn - 1)) + ((left(c) >= turn) & (c["camera"] <= own)).cast("int"))

    rows = ranked.withColumn("_all", F.lit(1)).join(every, "_all")
    rows = rows.withColumn("val", place(F.col("rank"), lambda c: c["n"]) <= n_val)
    taken = broadcast_if_small(rows.groupBy("camera").agg(F.count_if("val").alias("taken")).agg(
        F.sort_array(F.collect_list(F.struct("camera", "taken"))).alias("taken")).withColumn("_all", F.lit(1)))
    rest = rows.join(taken, "_all")
    gone = lambda camera: F.get(F.filter("taken", lambda t: t["camera"] == camera), F.lit(0))["taken"]
    turn = F.col("rank") - gone(F.col("camera"))
    train = place(turn, lambda c: c["n"] - gone(c["camera"])) <= n_train
    split = F.when(F.col("val"), "val").when(train, "train")
    return rest.select("camera", "stem", split.alias("split")).filter(F.col("split").isNotNull())


def split_tally(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split").agg(
        F.count(F.lit(1)).alias("images"), F.count_if(F.col("box_count") > 0).alias("positives"),
        F.count_if(F.col("box_count") == 0).alias("negatives"), F.sum("box_count").cast("bigint").alias("instances"),
    )


def training_gate(samples: DataFrame, minimum: int) -> DataFrame:
    """One row: how many images there are and whether that is enough."""
    n = F.count(F.lit(1))
    return samples.agg(n.alias("images"), F.count_if(F.col("box_count") > 0).alias("with_boxes"), (n >= minimum).alias("ready"))


def set_flags(events: DataFrame) -> DataFrame:
    """Current flags from set and clear events (task, rel_path, flag, value, ts); latest wins.

    Clearing removes every suffix form, so flags are keyed by stem.
    """
    latest = events.groupBy("task", stem_of(F.col("rel_path")).alias("stem"), "flag").agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("value")
    )
    return latest.filter("value")


def relabel_after_recrop(lines: DataFrame, images: DataFrame, old: tuple, new: tuple) -> DataFrame:
    """Rebased label lines of images in the pool."""
    return lines.join(images.select("stem"), "stem", "left_semi").withColumn("value", rebase_line(F.col("value"), old, new))


def relabel_tally(lines: DataFrame, images: DataFrame, relabelled: DataFrame) -> DataFrame:
    """Per camera: images of the pool, images with corrected labels, lines corrected."""
    fixed = relabelled.groupBy("camera", "stem").agg(F.count(F.lit(1)).alias("n")).groupBy("camera").agg(
        F.count(F.lit(1)).alias("relabelled"), F.sum("n").alias("lines")
    )
    pool = images.groupBy("camera").agg(F.count(F.lit(1)).alias("images"))
    return pool.join(fixed, "camera", "left").fillna(0)


# Text forms of labels ---------------------------------------------------------------------------


def label_texts(boxes: DataFrame, images: DataFrame, with_conf: bool = False) -> DataFrame:
    """Normalised label text of every image; an image without boxes has empty text.

    Boxes with corners (x1, y1, x2, y2) are clipped corner by corner, boxes given as x, y, w,
    h keep their size as far as the image goes.
    """
    if "x1" not in boxes.columns:
        from gaugeline.operators.measure import clip_sized

        corner = {"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x") + F.col("w"), "y2": F.col("y") + F.col("h")}
        boxes = clip_sized(boxes, images).withColumns(corner).drop("width", "height")
    sizes = images.select("img", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    fit = lambda c, size: F.greatest(F.lit(0.0), F.least(F.col(size), F.col(c)))
    placed = boxes.join(sizes, "img").select(
        "img", "width", "height", "yc", "box_id", "conf", fit("x1", "width").alias("x1"), fit("x2", "width").alias("x2"),
        fit("y1", "height").alias("y1"), fit("y2", "height").alias("y2"),
    )
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    numbers = [(F.col("x1") + 0.5 * w) / F.col("width"), (F.col("y1") + 0.5 * h) / F.col("height"), w / F.col("width"), h / F.col("height")]
    fields = [fixed6(v) for v in numbers] + ([fixed6(F.col("conf"))] if with_conf else [])
    lines = placed.filter((w > 0) & (h > 0)).withColumn("line", F.concat_ws(" ", F.lit("0"), *fields))
    texts = lines.groupBy("img").agg(
        F.expr("concat(array_join(transform(array_sort(collect_list(struct(yc, box_id, line))), l -> l.line), '\n'), '\n')").alias("text")
    )
    return images.join(texts, "img", "left").withColumn("text", F.coalesce("text", F.lit("")))


def polygon_texts(df: DataFrame, points: str = "points") -> DataFrame:
    """Class and x y pairs; a rectangle of the box where the polygon has under three points."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    box = F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"))
    used = F.when(F.coalesce(F.size(points), F.lit(0)) < 3, box).otherwise(F.col(points))
    unit = F.flatten(
        F.transform(used, lambda p: F.array(fixed6(p["x"] / F.col("width")), fixed6(p["y"] / F.col("height"))))
    )
    return df.withColumn("text", F.concat(F.lit("0 "), F.array_join(unit, " "), F.lit("\n")))
