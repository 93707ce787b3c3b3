"""Capture runs, exports and their histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions import scalars as S


def run_state(manifests: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """History row per manifest with zero-filled counts and a latest flag.

    ``latest`` is the pointer table (run_id); it holds at most one row per pointer.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    summary, counts = "processing.summary", "processing.tube_counts"
    rows = manifests.select(
        F.trim("run_id").alias("run_id"), text("captured_at").alias("captured_at"), text("status").alias("status"),
        *[zero(f"{summary}.{c}").alias(c) for c in ("matched", "left_only", "right_only")],
        *[zero(f"{counts}.{c}").alias(f"tubes_{c}") for c in ("cam151", "cam152")],
        text("processing.detection_source").alias("detection_source"),
        *[text(f"cameras.{c}.image_name").alias(f"{c}_image") for c in ("cam151", "cam152")],
        text("error").alias("error"), S.captured_date(F.col("captured_at")).alias("captured_date"),
    )
    if latest is None:
        return rows.withColumn("is_latest", F.lit(False))
    marked = latest.select("run_id", F.lit(True).alias("is_latest")).distinct()
    return rows.join(marked, "run_id", "left").withColumn("is_latest", F.coalesce("is_latest", F.lit(False)))


def latest_per_side(exports: DataFrame) -> DataFrame:
    """Newest export per side; files marked latest win over dated ones."""
    best = F.max_by(F.struct("path", "mtime"), F.struct("is_latest", "mtime", "path"))
    return exports.groupBy("side").agg(best.alias("b")).select("side", "b.*")


def newest_first(df: DataFrame, key: str = "run_id") -> DataFrame:
    """By parsed capture time, text as tie; rows without a time go by their id."""
    when = S.parse_iso_utc(F.col("captured_at"))
    return df.orderBy(when.desc_nulls_last(), F.coalesce(F.nullif("captured_at", F.lit("")), F.col(key)).desc(), F.col(key).desc())


def dataset_as_of(
    matches: DataFrame, exports: DataFrame, key: str, slice_seconds: int = 60, latest_name: str = "latest.json", latest: DataFrame | None = None,
) -> DataFrame:
    """The export each match was made from.

    An input named by the match wins unless it is the file ``latest_name``.  Else the newest
    by file time among exports stamped at or before the match; else, and for matches without
    a time, the newest stamped one; else the named input itself; else the key's row of
    ``latest`` (key, path).  Exports without a stamp take no part.  Time is cut into slices:
    each slice takes over the best of all slices before it, so a key with very many exports
    is spread over tasks and no match/export pairs are formed.
    """
    exports = exports.filter(F.col("stamp").isNotNull())
    best = F.struct("mtime", "path")
    none = F.lit(None).cast("struct<mtime:bigint,path:string>")
    at = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6 * slice_seconds)).cast("bigint")
    offered = exports.select(key, F.col("stamp").alias("ts"), F.lit(0).alias("kind"), best.alias("best"), F.lit(None).cast("bigint").alias("match_id"), F.lit(None).cast("string").alias("input_path"))
    asked = matches.select(key, F.col("match_ts").alias("ts"), F.lit(1).alias("kind"), none.alias("best"), "match_id", "input_path")
    rows = offered.unionByName(asked).withColumn("slice", at("ts"))
    so_far = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key)
    carried = rows.groupBy(key, "slice").agg(F.max("best").alias("top")).select(
        key, "slice", F.max("top").over(so_far).alias("before"), F.max("top").over(whole).alias("newest")
    )
    inside = Window.partitionBy(key, "slice").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    slices = carried.select(F.col(key).alias("_key"), F.col("slice").alias("_slice"), "before", "newest")
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("slice").eqNullSafe(F.col("_slice"))
    resolved = rows.withColumn("here", F.max("best").over(inside)).filter(F.col("kind") == 1).join(slices, same)
    if latest is None:
        resolved = resolved.withColumn("latest", F.lit(None).cast("string"))
    else:
        newest = latest.groupBy(F.col(key).alias("_latest_key")).agg(F.max("path").alias("latest"))
        resolved = resolved.join(newest, F.col(key).eqNullSafe(F.col("_latest_key")), "left")
    name = F.lower(F.regexp_extract("input_path", r"([^/\\\\]*)$", 1))
    stamped = F.when(name != latest_name.lower(), F.col("input_path"))
    as_of = F.when(F.col("ts").isNotNull(), F.greatest("before", "here")["path"])
    tiers = {"given": stamped, "as_of": as_of, "newest": F.col("newest")["path"], "input": F.col("input_path"), "latest": F.col("latest")}
    how = F.coalesce(*[F.when(path.isNotNull(), F.lit(tier)) for tier, path in tiers.items()], F.lit("none"))
    return resolved.select("match_id", key, F.coalesce(*tiers.values()).alias("path"), how.alias("how"))


def canonical_stem(stem: Column) -> Column:
    """cam_151_x and cam151_x name the same image."""
    return F.regexp_replace(stem, r"^cam_?(151|152)_", "cam$1_")


def pick_boundary(images: DataFrame, boundaries: DataFrame) -> DataFrame:
    """The boundary of an image: same size within two pixels, tallest, then newest."""
    named = boundaries.withColumn("key", canonical_stem(F.col("stem"))).select(
        "key", "source", F.col("width").alias("bw"), F.col("height").alias("bh"), "top", "bottom", "mtime"
    )
    fits = (F.coalesce(F.abs(F.col("bw") - F.col("width")), F.lit(0)) <= 2) & (F.coalesce(F.abs(F.col("bh") - F.col("height")), F.lit(0)) <= 2)
    tall = F.col("bottom") - F.col("top")
    rows = images.withColumn("key", canonical_stem(F.col("stem"))).join(named, "key").filter(fits)
    return rows.groupBy("stem").agg(
        F.max_by(F.struct("source", "top", "bottom"), F.struct(tall, F.col("mtime"), F.col("source"))).alias("b")
    ).select("stem", "b.*")


def capture_history(states: DataFrame, legacy: DataFrame) -> DataFrame:
    """Runs and imported results that used a bundle boundary, newest first."""
    columns = ["run_id", "captured_at", "status", "matched", "left_only", "right_only", "strategy", "has_boundary"]
    imported = legacy.filter(F.lower("name") != "tube_match_latest.json").select(
        F.concat(F.lit("artifact:"), F.regexp_replace("name", r"\.json$", "")).alias("run_id"), F.col("generated_at").alias("captured_at"),
        F.lit("imported_artifact").alias("status"), "matched", "left_only", "right_only", "strategy", "has_boundary",
    )
    rows = states.select(*columns).unionByName(imported)
    used = F.lower(F.coalesce("strategy", F.lit(""))).contains("sam") | F.coalesce("has_boundary", F.lit(False))
    return newest_first(rows.filter(used))


def selection_history(sources: list[DataFrame], artifacts: DataFrame, images: DataFrame) -> DataFrame:
    """Selectable captures (first source wins per id) and results, images present only."""
    ranked = None
    for rank, source in enumerate(sources):
        part = source.select("selection_id", "captured_at", "image_path", F.lit(rank).alias("source_rank"))
        ranked = part if ranked is None else ranked.unionByName(part)
    usable = ranked.join(images.select("image_path").distinct(), "image_path", "left_semi")
    first = usable.groupBy("selection_id").agg(
        F.min_by(F.struct("captured_at", "image_path", "source_rank"), F.struct("source_rank", "captured_at", "image_path")).alias("s")
    ).select("selection_id", "s.*")
    results = artifacts.join(images.select("image_path").distinct(), "image_path", "left_semi").select(
        "selection_id", "captured_at", "image_path", F.lit(len(sources)).alias("source_rank")
    )
    return newest_first(first.unionByName(results), "selection_id")


def timeline(captures: DataFrame, images: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline first, then captures by time, with hour labels; raw images present only."""
    rows = captures.join(images.select("image_path").distinct(), "image_path", "left_semi").select(
        F.lit("capture").alias("kind"), "side", "run_id", "captured_at", S.hour_label(F.col("captured_at")).alias("hour_label"), "status"
    )
    first = baseline.select(
        F.lit("default").alias("kind"), "side", "run_id", "captured_at", F.lit("Default baseline").alias("hour_label"), F.lit("default").alias("status")
    )
    every = first.unionByName(rows)
    return every.orderBy((F.col("kind") != "default").cast("int"), F.coalesce(F.nullif("captured_at", F.lit("")), F.col("run_id")), "run_id", "side")


def timeline_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("side").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("kind") == "capture").alias("captures"))


def plain_id(run_id: Column) -> Column:
    """Whether an id names one run and no path."""
    text = F.trim(run_id)
    return (text != "") & ~text.rlike(r"[/\\]") & ~text.isin(".", "..")


def retire_runs(runs: DataFrame, pointers: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs and latest pointers without the named runs; no successor is promoted."""
    named = ids.filter(plain_id(F.col("run_id"))).select(F.trim("run_id").alias("run_id")).distinct()
    return runs.join(named, "run_id", "left_anti"), pointers.join(named, "run_id", "left_anti")


def promote_latest(pointers: DataFrame, processed: DataFrame) -> DataFrame:
    """Pointer log with a new row per promoted run: (target, run_id, synced_at)."""
    targets = F.explode(F.array(F.lit("cam151"), F.lit("cam152"), F.lit("match")))
    return pointers.unionByName(processed.select(targets.alias("target"), "run_id", "synced_at"))


def latest_pointers(pointers: DataFrame) -> DataFrame:
    """The view of what is latest now: the last promotion of every target."""
    return pointers.groupBy("target").agg(F.max_by("run_id", F.struct("synced_at", "run_id")).alias("run_id"))


def best_epoch(results: DataFrame, metric: str) -> DataFrame:
    """Epoch with the best metric per run; blanks count 0, the first epoch wins ties."""
    value = F.coalesce(F.nullif(F.trim(metric), F.lit("")).try_cast("double"), F.lit(0.0))
    rows = results.select("run", F.col("epoch").try_cast("int").alias("epoch"), value.alias("metric"))
    return rows.groupBy("run").agg(F.max_by(F.struct("epoch", "metric"), F.struct(F.col("metric"), -F.col("epoch"))).alias("b")).select("run", "b.*")
