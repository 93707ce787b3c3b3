"""Writing labels, match runs, measurement exports and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.session import fresh_path


def write_labels(texts: DataFrame, path: str) -> None:
    """Label texts of images, partitioned by camera."""
    texts.write.mode("overwrite").partitionBy("camera").parquet(path)


#: Folders of a table of runs; a table keeps the number it was first written with.
BUCKETS = 64


def bucket_of(run: str = "run_id", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(run), F.lit(buckets)).cast("int")


def _stored(like: DataFrame, path: str, form: str) -> DataFrame | None:
    """What the table holds now, None before it is first written."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
    try:
        return like.sparkSession.read.schema(fields).format(form).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def replace_rows(rows: DataFrame, path: str, keys: list[str], form: str = "parquet", buckets: int = BUCKETS) -> None:
    """Puts rows into a table of hashed buckets: what it held for their keys goes, all else stays.

    The number of folders does not depend on the number of runs. Only touched buckets are read and written, and a bucket's rows
    are sorted by key, so that one run is found by its bucket and the file's statistics. Old and new rows meet in the one exchange
    that the write needs anyway.
    """
    new = rows.withColumn("bucket", bucket_of("run_id", buckets))
    before = _stored(new, path, form)
    if before is None:
        _write(new.repartition("bucket"), path, keys, form)
        return
    new = _kept(new)
    touched = _buckets(new)
    if touched:
        of_key = Window.partitionBy("bucket", *keys)
        old = before.where(F.col("bucket").isin(touched)).select(*new.columns, F.lit(False).alias("_new"))
        both = old.unionByName(new.withColumn("_new", F.lit(True))).repartition("bucket").withColumn("_last", F.max("_new").over(of_key))
        _write(both.where("_new = _last").drop("_new", "_last"), path, keys, form)


def remove_runs(runs: DataFrame, like: DataFrame, path: str, form: str = "parquet", buckets: int = BUCKETS) -> None:
    """Takes runs (`run_id`) out of a table whose rows look like `like`."""
    gone = _kept(runs.select("run_id").distinct().withColumn("bucket", bucket_of("run_id", buckets)))
    touched = _buckets(gone)
    before = _stored(like.withColumn("bucket", F.lit(0)), path, form)
    if before is None or not touched:
        return
    left = before.where(F.col("bucket").isin(touched)).join(gone, ["bucket", "run_id"], "left_anti").select(*before.columns)
    # a bucket that is empty now keeps a file without rows
    emptied = sorted(set(touched) - set(_buckets(left)))
    if emptied:
        none = left.sparkSession.createDataFrame([(b,) for b in emptied], "bucket int")
        left = left.unionByName(none, allowMissingColumns=True)
    _write(left.repartition("bucket"), path, ["run_id"], form)


def _kept(rows: DataFrame) -> DataFrame:
    """Rows that are used twice, stored in between; columns compressed, which takes a fraction of a checkpoint's room."""
    path = fresh_path(rows.sparkSession, "rows")
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _buckets(rows: DataFrame) -> list[int]:
    return [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # as many as there are buckets at most


def _write(dealt: DataFrame, path: str, keys: list[str], form: str) -> None:
    """Replaces the buckets that `dealt` has rows for; their old files stay until all new ones are whole, so they may be read for it."""
    writer = dealt.sortWithinPartitions("bucket", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if form == "json":
        writer = writer.option("compression", "gzip")
    writer.partitionBy("bucket").format(form).save(path)


def read_runs(spark, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """The rows of a table of runs."""
    return spark.read.schema(f"{schema}, bucket int").format(form).load(path).where(F.col("run_id").isNotNull()).drop("bucket")


def write_match_run(rows: DataFrame, path: str) -> None:
    """Match rows by run; a run that is written again replaces itself.  The latest run is a pointer, not a copy."""
    replace_rows(rows, path, ["run_id"])


def export_measurements(items: DataFrame, path: str) -> None:
    """One JSON object per run and side, with its items in order; a run and side written again replaces itself."""
    fields = [c for c in items.columns if c not in ("run_id", "side", "generated_at")]
    packed = items.groupBy("run_id", "side", "generated_at").agg(
        F.array_sort(F.collect_list(F.struct("source_order", *[f for f in fields if f != "source_order"]))).alias("items")
    )
    replace_rows(packed, path, ["run_id", "side"], "json")


def write_height_report(boxes: DataFrame, path: str, bins: int = 12, z: float = 2.5, top: int = 30) -> None:
    """Boxes as CSV and, per camera, one JSON object: fit, correlation, bins, outliers and the worst of them."""
    from gaugeline.operators import statistics as T

    boxes.write.mode("overwrite").option("header", "true").partitionBy("camera").csv(f"{path}/boxes")
    per_image = boxes.groupBy("camera", "img").agg(F.count(F.lit(1)).alias("n"))
    images = per_image.groupBy("camera").agg(F.sum("n").alias("boxes"), F.count(F.lit(1)).alias("images"))
    binned = T.height_bins(boxes, bins).groupBy("camera").agg(
        F.array_sort(F.collect_list(F.struct("bin", "n", "mean_h", "median_h", "min_h", "max_h"))).alias("bins")
    )
    far = T.height_outliers(boxes, z)
    counted = far.groupBy("camera").agg(F.count(F.lit(1)).alias("outliers"))
    worst = Window.partitionBy("camera").orderBy(F.desc("z"), "box_id")
    first = far.withColumn("_k", F.row_number().over(worst)).filter(F.col("_k") <= top).groupBy("camera").agg(
        F.array_sort(F.collect_list(F.struct("_k", "img", "box_id", "h", "z"))).alias("top")
    )
    summary = T.height_fit(boxes).join(images, "camera").join(binned, "camera").join(counted, "camera", "left").join(first, "camera", "left")
    summary.withColumn("outliers", F.coalesce("outliers", F.lit(0))).write.mode("overwrite").json(f"{path}/summary")
