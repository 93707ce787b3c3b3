"""Tables of runs: rows that replace rows, in one exchange, in little room."""

import glob

import pytest
from pyspark.sql import functions as F

from gaugeline.plans import views
from gaugeline.sources import sinks

SCHEMA = "run_id string, side string, n int"


@pytest.mark.parametrize("form", ["json", "parquet"])
def test_rows_replace_rows(spark, tmp_path, form):
    path = str(tmp_path / "table")
    table = lambda rows: spark.createDataFrame(rows, SCHEMA)
    stored = lambda: sorted(((r["run_id"], r["side"] or "", r["n"]) for r in sinks.read_runs(spark, path, SCHEMA, form).collect()))
    put = lambda rows: sinks.replace_rows(table(rows), path, ["run_id", "side"], form, buckets=3)
    put([("a", "151", 1), ("a", "152", 2), ("b", "151", 3), ("b", "151", 4), ("c", None, 5)])
    put([("a", "152", 6), ("a", "152", 7), ("c", None, 8), ("d", "151", 9)])  # side null is a side, too
    put([])
    want = [("a", "151", 1), ("a", "152", 6), ("a", "152", 7), ("b", "151", 3), ("b", "151", 4), ("c", "", 8), ("d", "151", 9)]
    assert stored() == want
    sinks.remove_runs(table([("a", None, 0), ("d", None, 0), ("x", None, 0)]), table([]), path, form, buckets=3)
    assert stored() == [row for row in want if row[0] not in "ad"]
    sinks.remove_runs(table([("b", None, 0), ("c", None, 0)]), table([]), path, form, buckets=3)
    assert stored() == []


def test_an_export_is_small_on_disk_and_in_transit(spark, tmp_path):
    path = str(tmp_path / "exports")
    items = views.items(spark, "/root/testdata/sf0.001").withColumn("generated_at", F.lit("t"))
    checkpoints = spark.sparkContext._jsc.sc().getCheckpointDir()
    before = glob.glob(f"{checkpoints.get().removeprefix('file:')}/rdd-*") if checkpoints.isDefined() else []
    sinks.export_measurements(items, path)
    sinks.export_measurements(items.filter(views.run_number() % 3 == 0), path)
    files = glob.glob(f"{path}/bucket=*/*.json*")
    assert files and all(name.endswith(".json.gz") for name in files) and len(files) <= sinks.BUCKETS
    assert (glob.glob(f"{checkpoints.get().removeprefix('file:')}/rdd-*") if checkpoints.isDefined() else []) == before


def test_boxes_are_dealt_before_their_columns_are_made(spark):
    plan = views.items(spark, "/root/testdata/sf0.001").groupBy("run_id", "side").agg(F.count("id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "box_id" not in plan[plan.index("Exchange"):]
