"""Reading label, manifest, flag, calibration and boundary files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from gaugeline import constants as K
from gaugeline.functions import scalars as S
from gaugeline.sources.annotation_files import read_files


def file_path() -> Column:
    return F.col("_metadata.file_path")


def relative(path: Column, root: str) -> Column:
    """Path below the root, whatever scheme the file system puts in front of either.

    The root is taken as text, from its first slash after a scheme; listed paths may be percent-encoded.
    """
    plain = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    decoded = F.when(F.instr(path, plain) > 0, path).otherwise(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))
    return F.substring(decoded, F.instr(decoded, plain) + len(plain), F.length(decoded))


# Labels ------------------------------------------------------------------------------------------


def scan_label_lines(spark: SparkSession, root: str) -> DataFrame:
    """Label lines with the camera directory and the relative stem of their file.

    Filters on ``camera`` leave the other cameras' files unopened.
    """
    return read_files(spark, root, "lines").select("value", "camera", F.regexp_replace("rel_path", r"\.txt$", "").alias("stem"))


def parse_labels(lines: DataFrame, mode: str = "five_or_six") -> DataFrame:
    """Numbers of label lines; other lines are skipped.

    Modes: five_or_six, five_or_more (fields); blank lines and classes but 0 are skipped, and
    so are lines with an unreadable number, which ``validate_labels`` reports.
    """
    others = [c for c in lines.columns if c != "value"]
    size = F.size("_f")
    fields = size.isin(5, 6) if mode == "five_or_six" else size >= 5
    number = lambda i: F.get("_f", F.lit(i)).try_cast("double")
    names = ("xn", "yn", "wn", "hn")
    # by way of `inline` a line is split once and a field cast once, not once per use
    once = lambda *columns: F.inline(F.array(F.struct(*columns)))
    rows = lines.filter(F.trim("value") != "").select(*others, once(F.split(F.trim("value"), r"\s+").alias("_f"))).filter(fields)
    rows = rows.select(*others, once(number(0).cast("int").alias("_class"), *[number(i).alias(n) for i, n in enumerate(names, start=1)], F.when(size >= 6, number(5)).alias("conf")))
    rows = rows.filter(F.col("_class") == 0)
    for n in names:
        rows = rows.filter(F.col(n).isNotNull())
    return rows.drop("_class")


def to_pixels(labels: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Scaled boxes of labels whose image size is known."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    zero = lambda v: F.greatest(F.lit(0.0), v)
    return labels.join(sizes, key).withColumns(
        {
            "x": zero(F.col("xn") * w - 0.5 * F.col("wn") * w), "y": zero(F.col("yn") * h - 0.5 * F.col("hn") * h),
            "w": zero(F.col("wn") * w), "h": zero(F.col("hn") * h),
        }
    )


def validate_labels(lines: DataFrame) -> DataFrame:
    """Adds ``error``: what a strict reader would reject, null for good lines."""
    rows = lines.withColumn("_f", F.split(F.trim("value"), r"\s+")).filter(F.trim("value") != "")
    numbers = F.transform(F.slice("_f", 2, 4), lambda t: t.try_cast("double"))
    w, h = F.get("_n", F.lit(2)), F.get("_n", F.lit(3))
    error = (
        F.when(F.size("_f") != 5, "field_count").when(F.coalesce(F.get("_f", F.lit(0)).try_cast("int"), F.lit(-1)) != 0, "class")
        .when(F.exists("_n", lambda v: v.isNull()), "number").when(F.exists("_n", lambda v: ~v.between(0.0, 1.0)), "range")
        .when((w <= 0) | (h <= 0), "empty")
    )
    return rows.withColumn("_n", numbers).withColumn("error", error).drop("_f", "_n")


# JSON entities -----------------------------------------------------------------------------------

MANIFEST = (
    "run_id string, captured_at string, status string, error string, "
    "cameras struct<cam151:struct<image_name:string,image_path:string,captured_at:string>,cam152:struct<image_name:string,image_path:string,captured_at:string>>, "
    "processing struct<summary:struct<matched:int,left_only:int,right_only:int>,tube_counts:struct<cam151:int,cam152:int>,"
    "detection_source:string,match_path:string>, _corrupt_record string"
)
DATASET = (
    "run_id string, side string, dataset_name string, generated_at string, reference_in double, base_central_in double, "
    "items array<struct<tube_idx:string,distance_in:string,offset_px:string,relative_position:string,active:boolean,unmatched:boolean,notes:string,"
    "source_measurement:string,y_center_warp:string,box_xywh:string,box_xyxy:string,source:string>>, extra_meta string"
)
# Where a data set may carry the bounds of its bundle, in this order.
BOUNDS_KEYS = ["sam_bundle_bounds_y", "sam_boundary_bounds_y", "bundle_bounds_y", "recovery_bounds_y"]
BOUNDS_PATHS = [
    *BOUNDS_KEYS, *[f"sam_boundary.{key}" for key in BOUNDS_KEYS], "pipe_end_yolo.recovery_bounds_y", "pipe_end_yolo.postprocess.edge_gap_recovery.bounds_y",
]
MATCH = (
    "run_id string, version int, generated_at string, matching_strategy string, "
    "rows array<struct<tube_number:int,match_status:string,total_length_in:double>>"
)
FLAGS = "bad_warp map<string,boolean>, negative_labels map<string,map<string,boolean>>"
BOUNDARY = (
    "width int, height int, mask_polygon array<array<double>>, boundary array<array<double>>, left_boundary array<array<double>>, right_boundary array<array<double>>"
)


def scan_json(spark: SparkSession, root: str, schema: str, whole_files: bool) -> DataFrame:
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true")
    return reader.option("multiLine", str(whole_files).lower()).json(root)


def scan_json_files(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Objects of many small JSON files of one object, or one list of objects, each; files are packed into tasks by bytes."""
    fields = StructType.fromDDL(schema)
    text = F.regexp_replace("value", "^\ufeff", "")
    objects = F.when(text.rlike(r"^\s*\["), F.from_json(text, ArrayType(fields))).otherwise(F.array(F.from_json(text, fields)))
    return read_files(spark, root, "text").select(F.explode(objects).alias("o")).select("o.*")


def scan_manifests(spark: SparkSession, root: str, whole_files: bool = True) -> DataFrame:
    """Readable run manifests, newest first by capture time, else by run id."""
    rows = scan_json(spark, root, MANIFEST, whole_files).filter(F.col("_corrupt_record").isNull() & F.col("run_id").isNotNull())
    when = S.parse_iso_utc(F.col("captured_at"))
    return rows.drop("_corrupt_record").withColumn("captured_ts", when).orderBy(
        F.col("captured_ts").desc_nulls_last(), F.coalesce("captured_at", "run_id").desc(), F.col("run_id").desc()
    )


def read_sets(spark: SparkSession, root: str, whole_files: bool) -> DataFrame:
    sets = (scan_json_files if whole_files else partial(scan_json, whole_files=False))(spark, root, DATASET)
    sets = sets.withColumn("side", S.norm_side(F.col("side")))
    return sets.filter(F.col("side").isNotNull() & F.col("items").isNotNull())


def _once(*columns: Column) -> Column:
    """By way of `inline` a value is computed once, not once per use."""
    return F.inline(F.array(F.struct(*columns)))


#: What matching needs of the measurement of an item; boxes are arrays, or texts of arrays.
BOXES = ("box_xywh", "box_xyxy")
MEASURED = ("y_center_warp", "source", *BOXES)


def _with_measured(rows: DataFrame) -> DataFrame:
    """Replaces the exploded item ``i`` by its vertical centre, box height and model source.

    They come from the measurement an item was made from, or from the item itself where it carries none. A measurement is
    parsed once; only a box that is no plain array in it is looked up again.
    """
    others = [c for c in rows.columns if c != "i"]
    text, array = F.col("i.source_measurement"), "array<string>"
    rows = rows.select(*others, F.when(text.rlike(r"^\s*\{"), text).alias("_text"), *[F.col(f"i.{key}").alias(f"_{key}") for key in MEASURED])
    parsed = F.from_json("_text", ", ".join(f"{key} {array if key in BOXES else 'string'}" for key in MEASURED))
    rows = rows.select(*others, "_text", *[f"_{key}" for key in MEASURED], _once(parsed.alias("_m")))
    value = lambda key: F.when(F.col("_text").isNotNull(), F.col(f"_m.{key}")).otherwise(F.col(f"_{key}"))

    def box(key: str) -> Column:
        again = F.when(F.col(f"_m.{key}").isNull() & F.contains("_text", F.lit(key)), F.from_json(F.get_json_object("_text", f"$.{key}"), array))
        return F.when(F.col("_text").isNull(), F.from_json(f"_{key}", array)).otherwise(F.coalesce(f"_m.{key}", again))

    rows = rows.select(*others, _once(value("y_center_warp").alias("_y"), value("source").alias("_s"), *[box(key).alias(f"_{key}") for key in BOXES]))
    size = lambda key: F.coalesce(F.when(F.col(f"_{key}").isNotNull(), F.size(f"_{key}")), F.lit(0))
    part = lambda key, n: S.lenient_double(F.get(f"_{key}", F.lit(n)))
    height = F.when(size("box_xywh") >= 4, part("box_xywh", 3)).when(size("box_xyxy") >= 4, F.abs(part("box_xyxy", 3) - part("box_xyxy", 1)))
    model = F.coalesce(F.col("_s") == K.MODEL_SOURCE, F.lit(False))
    return rows.select(*others, S.lenient_double(F.col("_y")).alias("y_center"), height.alias("box_height"), model.alias("model_source"))


#: Columns of a set's header, as matching needs them.
HEADER = ("bounds_top", "bounds_bottom", "detection_source", "model_block", "image_w", "image_h", "roi_x", "roi_y", "roi_w", "roi_h")


def _headers() -> list[Column]:
    from gaugeline.operators.matching import bundle_bounds

    meta = lambda path: F.get_json_object("extra_meta", f"$.{path}")

    def interval(text: Column) -> Column:
        first = lambda *keys: S.lenient_double(F.coalesce(*[F.get_json_object(text, k) for k in keys]))
        return F.struct(first("$.top", "$.y_min", "$.min_y", "$[0]").alias("top"), first("$.bottom", "$.y_max", "$.max_y", "$[1]").alias("bottom"))

    # each place is looked up once, and only what is there is taken apart
    bounds = bundle_bounds(F.transform(F.array_compact(F.array(*[meta(path) for path in BOUNDS_PATHS])), interval))
    size = lambda key: S.lenient_double(meta(f"pipe_end_yolo.image_size.{key}"))
    roi = lambda n: S.lenient_double(meta(f"detection_roi[{n}]"))
    values = (
        bounds["low"], bounds["high"], meta("detection_source"), F.coalesce(meta("pipe_end_yolo").rlike(r"^\s*\{"), F.lit(False)), size("width"), size("height"), *[roi(n) for n in range(4)],
    )
    return [value.alias(name) for value, name in zip(values, HEADER)]


def scan_dataset_headers(spark: SparkSession, root: str, whole_files: bool = True) -> DataFrame:
    """One row per run and side: bundle bounds, detection source, image size and region, as matching needs them."""
    return read_sets(spark, root, whole_files).select("run_id", "side", *_headers())


def _set_items(sets: DataFrame, *others: str) -> DataFrame:
    """Items of sets, one row each, read in one pass; `others` are columns of the set that go along."""
    default = F.when(F.col("side") == "151", K.LEFT_REFERENCE_IN).otherwise(K.RIGHT_REFERENCE_IN)
    rows = sets.filter(F.col("run_id").isNotNull()).select(
        "run_id", "side", *others, F.coalesce(F.nullif("reference_in", F.lit(0.0)), default).alias("reference_in"),
        F.coalesce(F.nullif("base_central_in", F.lit(0.0)), F.lit(K.BASE_CENTRAL_IN)).alias("base_central_in"),
        F.posexplode("items").alias("position", "i"),
    )
    kept = ["reference_in", "base_central_in", "active", "unmatched", "notes", "y_center", "box_height", "model_source"]
    raw = _with_measured(rows.select(
        "run_id", "side", *others, F.col("position").cast("bigint").alias("position"), F.col("i.tube_idx").alias("raw_tube_idx"),
        F.col("i.distance_in").alias("raw_distance"), F.col("i.offset_px").alias("raw_offset"), F.col("i.relative_position").alias("raw_relative"),
        "reference_in", "base_central_in", F.coalesce("i.active", F.lit(True)).alias("active"), F.coalesce("i.unmatched", F.lit(False)).alias("unmatched"),
        F.substring(F.trim(F.coalesce("i.notes", F.lit(""))), 1, 200).alias("notes"), "i",
    ))
    from gaugeline.operators.measure import normalize_items

    return normalize_items(raw, *kept, *others)


def scan_datasets(spark: SparkSession, root: str, whole_files: bool = True) -> DataFrame:
    """Measured items of both sides, one row each, with the reference lengths of their set.

    Centre, box height and source come from the measurement an item was made from, or from
    the item itself where it carries none.
    """
    return _set_items(read_sets(spark, root, whole_files))


def scan_datasets_with_headers(spark: SparkSession, root: str, whole_files: bool = True) -> DataFrame:
    """Items as of ``scan_datasets``, each with the header of its set, so that the files are read and parsed once."""
    sets = read_sets(spark, root, whole_files)
    others = [c for c in sets.columns if c != "extra_meta"]
    return _set_items(sets.select(*others, _once(*_headers())), *HEADER)


def scan_match_results(spark: SparkSession, root: str, whole_files: bool = True) -> DataFrame:
    """Match rows of results that hold a list of rows; the version defaults to 1."""
    results = scan_json(spark, root, MATCH, whole_files).filter(F.col("rows").isNotNull())
    version = F.coalesce(F.nullif("version", F.lit(0)), F.lit(1))
    return results.select("run_id", version.alias("version"), "matching_strategy", F.explode("rows").alias("r")).select(
        "run_id", "version", "matching_strategy", "r.*"
    )


def scan_image_flags(spark: SparkSession, root: str, whole_files: bool = True) -> DataFrame:
    """Flag rows (task, rel_path, flag, value); content that is no object gives none."""
    status = scan_json(spark, root, FLAGS, whole_files)
    clean = lambda c: F.translate(c, "\\", "/")
    bad = status.select(F.explode(F.map_entries("bad_warp")).alias("e")).select(
        F.lit(None).cast("string").alias("task"), clean(F.col("e.key")).alias("rel_path"), F.lit("bad_warp").alias("flag"), F.col("e.value").alias("value")
    )
    tasks = status.select(F.explode(F.map_entries("negative_labels")).alias("t"))
    negative = tasks.select(F.col("t.key").alias("task"), F.explode(F.map_entries("t.value")).alias("e")).select(
        "task", clean(F.col("e.key")).alias("rel_path"), F.lit("negative").alias("flag"), F.col("e.value").alias("value")
    )
    return bad.unionByName(negative)


def scan_images(spark: SparkSession, root: str, suffixes: list[str] = K.IMAGE_SUFFIXES, camera: str | None = None) -> DataFrame:
    """Image files below the root: the listing only, file contents are not read."""
    files = read_files(spark, root, "listing").select("rel_path", "camera", "suffix", "length").filter(F.col("suffix").isin(suffixes))
    return files if camera is None else files.filter(F.col("camera") == camera)


def scan_boundaries(spark: SparkSession, root: str, whole_files: bool = True) -> DataFrame:
    """Boundary polygons with source and camera from the path and their y bounds.

    Files hold one object each, or one in each line; content that cannot be read is skipped.
    """
    files = read_files(spark, root, "text" if whole_files else "lines")
    rel = F.split("rel_path", "/")
    rows = files.select("rel_path", F.col("modified").alias("mtime"), F.from_json("value", BOUNDARY).alias("b")).select("rel_path", "mtime", "b.*")
    ys = F.flatten(
        F.array(*[F.coalesce(F.transform(c, lambda p: F.get(p, F.lit(1))), F.array().cast("array<double>")) for c in ("mask_polygon", "boundary", "left_boundary", "right_boundary")])
    )
    rows = rows.withColumn("_ys", F.filter(ys, lambda y: y.isNotNull())).filter(F.size("_ys") >= 2)
    strip = lambda c: F.regexp_replace(c, "^[a-z]+=", "")
    return rows.select(
        strip(rel[0]).alias("source"), strip(rel[1]).alias("camera"), "width", "height", "mtime",
        F.array_min("_ys").alias("top"), F.array_max("_ys").alias("bottom"),
    )


def scan_training_results(spark: SparkSession, root: str) -> DataFrame:
    """Per-epoch metrics; names and values trimmed, bad numbers null."""
    raw = spark.read.option("header", "true").option("recursiveFileLookup", "true").csv(root)
    named = raw.toDF(*[c.strip() for c in raw.columns])
    return named.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in named.columns])


# Calibrations ------------------------------------------------------------------------------------

CALIBRATION = (
    "image_name string, image_path string, updated_at string, src_points_override array<string>, dst_rect_override string, "
    "points array<struct<id:string,kind:string,label:string,x:string,y:string,note:string>>, "
    "lines array<struct<id:string,kind:string,label:string,x1:string,y1:string,x2:string,y2:string,real_distance:string,coordinate_space:string>>, "
    "rois array<struct<id:string,xyxy:array<string>,note:string>>"
)


def _toml_to_json(batches: Iterator) -> Iterator:
    """TOML bytes to JSON text, null where they cannot be read; the one place that needs Python."""
    import json
    import tomllib

    def text(content) -> str | None:
        try:
            return json.dumps(tomllib.loads(bytes(content).decode("utf-8")), default=str)
        except ValueError:
            return None

    for batch in batches:
        yield batch.assign(content=batch["content"].map(text))


def load_calibrations(spark: SparkSession, root: str) -> DataFrame:
    """Calibrations of all TOML files; a JSON twin serves where there is no readable TOML.

    A calibration whose files are all unreadable is one row with ``error`` and nothing else.
    Corners may be pairs or objects; four readable ones make ``src_points``.  Missing whole
    numbers are 0, names and kinds have defaults, unreadable numbers are null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    toml = files.filter(kind == "toml").mapInPandas(_toml_to_json, "path string, content string")
    texts = toml.unionByName(files.filter(kind == "json").withColumn("content", F.try_validate_utf8(F.col("content").cast("string"))))
    parsed = F.when(F.col("content").rlike(r"^\s*\{"), F.from_json("content", CALIBRATION + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    rows = texts.select(F.regexp_replace("path", r"\.[A-Za-z]+$", "").alias("stem"), kind.alias("kind"), parsed.alias("c"))
    readable = F.col("c").isNotNull() & F.col("c._corrupt_record").isNull()
    best = rows.groupBy("stem").agg(F.max_by(F.struct(readable.alias("good"), "c"), F.struct(readable, F.col("kind") == "toml")).alias("b"))
    c = lambda name: F.when(F.col("b.good"), F.col(f"b.c.{name}"))
    filled = lambda v, default: F.coalesce(F.nullif(v, F.lit("")), F.lit(default) if isinstance(default, str) else default)
    whole = lambda v: F.when(v.isNull(), 0).otherwise(v.try_cast("double").cast("int"))
    named = lambda e, i, kind_: filled(e["id"], F.format_string(kind_ + "_%02d", i + 1))
    at = lambda v, key, i: F.coalesce(F.get_json_object(v, f"$.{key}"), F.get_json_object(v, f"$[{i}]")).try_cast("double")
    listed = lambda name, entry: F.when(F.col("b.good"), F.coalesce(F.transform(c(name), entry), F.array()))
    corners = F.transform(c("src_points_override"), lambda v: F.struct(at(v, "x", 0).alias("x"), at(v, "y", 1).alias("y")))
    four = F.when((F.size(corners) == 4) & F.forall(corners, lambda q: q["x"].isNotNull() & q["y"].isNotNull()), corners)
    rect = F.array(*[at(c("dst_rect_override"), key, i) for i, key in enumerate(("x0", "y0", "x1", "y1"))])
    return best.select(
        relative(F.col("stem"), root).alias("cal_id"), F.coalesce(c("image_name"), c("image_path")).alias("image_name"), c("updated_at").alias("updated_at"),
        four.alias("src_points"), F.when(F.forall(rect, lambda v: v.isNotNull()), rect).alias("dst_rect"),
        listed("points", lambda e, i: F.struct(
            named(e, i, "point").alias("id"), filled(e["kind"], "mark").alias("kind"), filled(e["label"], "").alias("label"),
            *[whole(e[k]).alias(k) for k in ("x", "y")], filled(e["note"], "").alias("note"),
        )).alias("points"),
        listed("lines", lambda e, i: F.struct(
            named(e, i, "line").alias("id"), filled(e["kind"], "horizontal_ref").alias("kind"), filled(e["label"], "").alias("label"),
            *[whole(e[k]).alias(k) for k in ("x1", "y1", "x2", "y2")], e["real_distance"].try_cast("double").alias("real_distance"),
            filled(e["coordinate_space"], "").alias("coordinate_space"),
        )).alias("lines"),
        listed("rois", lambda e, i: F.struct(
            named(e, i, "roi").alias("id"), F.transform(F.coalesce(e["xyxy"], F.array(*[F.lit("0")] * 4)), whole).alias("xyxy"), filled(e["note"], "").alias("note"),
        )).alias("rois"),
        F.when(~F.col("b.good"), "unreadable").alias("error"),
    )


def calibration_rows(calibrations: DataFrame, kind: str) -> DataFrame:
    """Points, lines or rois of calibrations, one row each with its position."""
    return calibrations.select("cal_id", F.posexplode(kind).alias("position", "e")).select("cal_id", "position", "e.*")
