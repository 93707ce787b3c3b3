"""Bindings: detection tables derived from the driver tables, for Spark and for DuckDB.

Sixteen neighbouring orders are one run, their line items its boxes, and the parity of the part tells the camera. An order
has a handful of lines, so an image has a few dozen boxes at every size of the tables. A series is what one user did, as long
as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ORDERS_PER_RUN = 16
WIDTH = 1280
HEIGHT = 1536


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def boxes(spark: SparkSession, sf: str, by_run: bool = False) -> DataFrame:
    """Boxes; dealt by run if so asked, as the few numbers that all columns come from."""
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )
    w = F.lit(20.0) + F.col("l_quantity") * F.lit(0.5)
    h = F.lit(12.0) + F.col("l_quantity") * F.lit(0.4)
    xc = F.lit(600.0) + F.col("l_tax") * F.lit(1000.0)
    yc = F.col("l_extendedprice") / F.lit(70.0)
    run = F.expr(f"l_orderkey div {ORDERS_PER_RUN}").cast("string")
    items = items.repartition(run) if by_run else items
    side = F.when(F.col("l_partkey") % 2 == 0, "151").otherwise("152")
    return items.select(
        run.alias("run_id"),
        side.alias("side"),
        F.concat(run, F.lit("/"), side).alias("img"),
        F.concat_ws(
            ":",
            *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_suppkey")],
            F.col("l_quantity").cast("bigint").cast("string"),
            F.rint(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        ).alias("box_id"),
        F.lit(0).alias("class_id"),
        (F.abs("l_discount") * F.lit(10.0)).alias("conf"),
        xc.alias("xc"), yc.alias("yc"), w.alias("w"), h.alias("h"),
        (xc - F.lit(0.5) * w).alias("x1"), (yc - F.lit(0.5) * h).alias("y1"),
        (xc + F.lit(0.5) * w).alias("x2"), (yc + F.lit(0.5) * h).alias("y2"),
        F.array().cast("array<string>").alias("flags"),
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus",
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Measured objects of both sides; positions and numbers from the boxes of a run."""
    from pyspark.sql import Window

    down = Window.partitionBy("run_id", "side").orderBy("yc", "box_id")
    ranked = boxes(spark, sf, by_run=True).withColumn("tube_idx", F.row_number().over(down))
    return ranked.select(
        "run_id", "side",
        F.col("box_id").alias("id"),
        "tube_idx",
        (F.col("tube_idx") - 1).alias("source_order"),
        (F.abs(F.col("xc") - 610.0) / 5.0).alias("distance_in"),
        (F.col("xc") - 610.0).alias("offset_px"),
        F.when(F.col("side") == "152", F.when(F.col("xc") < 610.0, "after").otherwise("before")).alias("relative_position"),
        (F.col("l_returnflag") != "A").alias("active"),
        ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 7)).alias("unmatched"),
        F.when(F.col("l_linenumber") == 1, "check").otherwise("").alias("notes"),
        F.col("yc").alias("y_center"),
        F.col("h").alias("box_height"),
        (F.lit(610.0) + 0.0 * F.col("xc")).alias("ref_x"),
    )


def run_number(column: str = "run_id"):
    return F.col(column).cast("bigint")


def datasets(spark: SparkSession, sf: str) -> DataFrame:
    """One header per run and side: bounds, source, image size and crop, some missing."""
    n = run_number()
    span = boxes(spark, sf).groupBy("run_id", "side").agg(F.min("yc").alias("lo"), F.max("yc").alias("hi"))
    crop = lambda v: F.when(n % 4 == 0, F.lit(float(v)))
    return span.select(
        "run_id", "side",
        F.when(n % 3 != 0, F.col("lo") - 20.0).alias("bounds_top"), F.when(n % 3 != 0, F.col("hi") + 20.0).alias("bounds_bottom"),
        F.when(n % 2 == 0, "yolo_pipe_end").otherwise("classic").alias("detection_source"),
        F.when(n % 5 != 0, F.lit(float(WIDTH))).alias("image_w"), F.when(n % 5 != 0, F.lit(float(HEIGHT))).alias("image_h"),
        crop(10).alias("roi_x"), crop(20).alias("roi_y"), crop(WIDTH).alias("roi_w"), crop(HEIGHT).alias("roi_h"),
    )


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Value series: one per user."""
    from pyspark.sql import Window

    events = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    named = events.withColumn("series", F.col("user_id").cast("string"))
    order = Window.partitionBy("series").orderBy("ts", "event_id")
    return named.select(
        "series", (F.row_number().over(order) - 1).cast("bigint").alias("idx"), F.col("value")
    )


# The same views as DuckDB text ------------------------------------------------------

VIEWS: dict[str, str] = {
    "v_boxes": """
  SELECT run_id, side, run_id || '/' || side AS img,
         concat_ws(':', l_orderkey, l_linenumber, l_suppkey, CAST(l_quantity AS BIGINT),
                   CAST(round_even(l_extendedprice * 100, 0) AS BIGINT)) AS box_id,
         abs(l_discount) * 10.0::DOUBLE AS conf, xc, yc, w, h,
         xc - 0.5::DOUBLE * w AS x1, yc - 0.5::DOUBLE * h AS y1,
         xc + 0.5::DOUBLE * w AS x2, yc + 0.5::DOUBLE * h AS y2,
         l_orderkey, l_linenumber, l_returnflag, l_linestatus
  FROM (SELECT l.*, (l_orderkey // 16)::VARCHAR AS run_id, CASE WHEN l_partkey % 2 = 0 THEN '151' ELSE '152' END AS side,
               600.0::DOUBLE + l_tax * 1000.0::DOUBLE AS xc, l_extendedprice / 70.0::DOUBLE AS yc,
               20.0::DOUBLE + l_quantity * 0.5::DOUBLE AS w, 12.0::DOUBLE + l_quantity * 0.4::DOUBLE AS h
        FROM lineitem l)""",
    "v_items": """
  SELECT run_id, side, box_id AS id, CAST(row_number() OVER (PARTITION BY run_id, side ORDER BY yc, box_id) AS INTEGER) AS tube_idx,
         CAST(row_number() OVER (PARTITION BY run_id, side ORDER BY yc, box_id) - 1 AS INTEGER) AS source_order, abs(xc - 610.0::DOUBLE) / 5.0::DOUBLE AS distance_in,
         xc - 610.0::DOUBLE AS offset_px,
         CASE WHEN side = '152' THEN CASE WHEN xc < 610.0 THEN 'after' ELSE 'before' END END AS relative_position,
         l_returnflag <> 'A' AS active, (l_linestatus = 'F' AND l_linenumber = 7) AS unmatched,
         CASE WHEN l_linenumber = 1 THEN 'check' ELSE '' END AS notes,
         yc AS y_center, h AS box_height, 610.0::DOUBLE AS ref_x
  FROM v_boxes""",
    "v_datasets": """
  SELECT run_id, side, n, CASE WHEN n % 3 <> 0 THEN lo - 20.0::DOUBLE END AS bounds_top, CASE WHEN n % 3 <> 0 THEN hi + 20.0::DOUBLE END AS bounds_bottom,
         CASE WHEN n % 2 = 0 THEN 'yolo_pipe_end' ELSE 'classic' END AS detection_source,
         CASE WHEN n % 5 <> 0 THEN 1280.0::DOUBLE END AS image_w, CASE WHEN n % 5 <> 0 THEN 1536.0::DOUBLE END AS image_h,
         CASE WHEN n % 4 = 0 THEN 10.0::DOUBLE END AS roi_x, CASE WHEN n % 4 = 0 THEN 20.0::DOUBLE END AS roi_y,
         CASE WHEN n % 4 = 0 THEN 1280.0::DOUBLE END AS roi_w, CASE WHEN n % 4 = 0 THEN 1536.0::DOUBLE END AS roi_h
  FROM (SELECT run_id, side, CAST(run_id AS BIGINT) AS n, min(yc) AS lo, max(yc) AS hi FROM v_boxes GROUP BY ALL)""",
    "v_profile": """
  SELECT series, row_number() OVER (PARTITION BY series ORDER BY ts, event_id) - 1 AS idx, value
  FROM (SELECT *, user_id::VARCHAR AS series FROM events)""",
    "v_gaps": """
  SELECT *, lead(yc) OVER (PARTITION BY img ORDER BY yc, box_id) - yc AS gap FROM v_boxes""",
}

NEEDS = {"v_items": ["v_boxes"], "v_gaps": ["v_boxes"], "v_datasets": ["v_boxes"]}


def sql(names: str, body: str, recursive: bool = False) -> str:
    """Puts the named views (and what they need) in front of a query."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    heads = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in ordered)
    text = body.strip()
    if text.lower().startswith("with "):
        return f"WITH {'RECURSIVE ' if recursive else ''}{heads},\n{text[5:]}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{heads}\n{text}"
