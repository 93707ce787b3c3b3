"""Chains that read and deal their rows once: no row is written in between."""

from gaugeline.plans import load_all
from gaugeline.plans.registry import QUERIES

load_all()
SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_a_match_deals_the_items_once_and_stores_nothing(spark):
    for name in ("e10_select_strategy", "b12_observations", "b14_display_rows", "g2_slot_set_operations"):
        text = plan(QUERIES[name](spark, SF))
        assert "ExistingRDD" not in text, name
        # the items, and the headers by side and by run
        assert text.count("Exchange hashpartitioning") <= 3, (name, text)


def test_boxes_meet_only_in_runs_that_share_height(spark):
    from pyspark.sql import functions as F

    from gaugeline.operators import boxes as B

    box = lambda i, y: F.struct(F.lit(str(i)).alias("id"), F.lit(float(y)).alias("y1"), F.lit(y + 10.0).alias("y2"))
    rows = spark.range(1).select(F.array(*[box(i, y) for i, y in enumerate((40, 0, 5, 14, 24, 52))]).alias("b"))
    runs = rows.select(F.transform(B.touching_runs(F.col("b")), lambda r: F.transform(r, lambda b: b["id"]))).first()[0]
    # a box that begins where all before it end begins a new run
    assert [r for r in runs if r] == [["1", "2", "3"], ["4"], ["0"], ["5"]]


def test_roughness_takes_its_mean_once(spark):
    rough = QUERIES["c16_boundary_roughness"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # left and right: one sum for the mean, one for the spread
    assert rough.count("aggregate(") <= 4, rough.count("aggregate(")
