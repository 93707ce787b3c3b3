"""The cleaning chain on batches of images: against the column rules on random stacks with ties, odd rows, one pass over the boxes."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeline import constants as K
from gaugeline.functions.boxes import from_corners
from gaugeline.operators import boxes as B
from gaugeline.operators import recovery as R
from gaugeline.operators import stacks
from gaugeline.plans import load_all
from gaugeline.plans.registry import QUERIES

load_all()
BOX = "run_id string, side string, img string, box_id string, conf double, x1 double, y1 double, x2 double, y2 double, flags array<string>"


@pytest.fixture(scope="module")
def boxes(spark):
    """Crowded and loose stacks; whole numbers, so that heights, confidences, areas and names meet."""
    rows = []
    for n in range(60):
        rng = random.Random(n)
        for i in range(rng.choice([1, 2, 3, 5, 30, 60])):
            x, y = rng.randrange(90, 110), rng.randrange(0, rng.choice([60, 400, 1500]), rng.choice([1, 5]))
            w, h = rng.choice([0, 8, 10, 12, 40]), rng.choice([1, 8, 10, 12, 30])
            rows.append(("r", str(n % 2), f"i{n}", f"b{rng.randrange(40)}", rng.randrange(10) / 10, x - w / 2.0, y - h / 2.0, x + w / 2.0, y + h / 2.0, rng.choice([[], [], ["old"], ["old", "older"]])))
    return from_corners(spark.createDataFrame(rows, BOX).repartition(3)).cache()


def listed(df):
    return sorted((r["img"], *(r[c] if c != "flags" else tuple(r[c]) for c in B.FIELDS)) for r in df.collect())


def run(boxes, steps):
    return listed(B.unpack(R.run_steps(B.pack(boxes, "kept"), steps, "kept"), "kept"))


@pytest.mark.parametrize("chunk", [1, 100, stacks.CHUNK])
def test_steps_are_the_column_rules(spark, boxes, chunk, monkeypatch):
    monkeypatch.setattr(stacks, "CHUNK", chunk)
    single = B.unpack(B.dedupe(B.pack(boxes)))
    assert run(boxes, [("dedupe", {})]) == listed(single)
    assert run(single, [("clusters", {})]) == listed(B.isolated_clusters(single))
    assert run(single, [("lateral", {"base_conf": K.DETECTOR_CONF})]) == listed(B.drop_lateral_outliers(single))


def test_tall_boxes_are_cut_where_the_column_rule_says(spark, boxes):
    single = B.unpack(B.dedupe(B.pack(boxes))).dropDuplicates(["img", "box_id"]).localCheckpoint()
    tall = B.oversize_boxes(single).filter("decision = 'candidate'")
    cut = F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda k: F.col("y1") + k * (F.col("h") / F.col("parts")))
    parts = R.split_oversize(single, tall.select(*B.IMAGE, "box_id", cut.alias("seps")))
    want, cut_ones = {}, set()
    for r in tall.collect():
        borders = [max(0.0, v) for v in (r["y1"], *[r["y1"] + k * (r["h"] / r["parts"]) for k in range(1, r["parts"])], r["y2"])]
        if all(low - top >= 0.35 * r["median_h"] for top, low in zip(borders, borders[1:])):
            cut_ones.add((r["img"], r["box_id"]))
            want |= {(r["img"], f"{r['box_id']}/{k}"): (top, low, *r["flags"], K.FLAG_SPLIT) for k, (top, low) in enumerate(zip(borders, borders[1:]), 1)}
    got = parts.collect()
    assert {(r["img"], r["box_id"]): (r["y1"], r["y2"], *r["flags"]) for r in got if r["was_split"]} == want and want
    assert sorted((r["img"], r["box_id"]) for r in got if not r["was_split"]) == sorted({(r["img"], r["box_id"]) for r in single.collect()} - cut_ones)


def test_images_without_boxes_and_boxes_without_numbers(spark):
    box = "struct<yc:double,box_id:string,xc:double,w:double,h:double,x1:double,y1:double,x2:double,y2:double,conf:double,flags:array<string>>"
    one = lambda y, name, conf=0.9: (y, name, 100.0, 20.0, 20.0, 90.0, y - 10, 110.0, y + 10, conf, [])
    rows = [
        ("r", "151", "none", None, None, None), ("r", "151", "empty", [], [one(40.0, "w")], 500.0),
        ("r", "151", "holes", [one(100.0, "a"), one(130.0, None), one(190.0, "d"), (None, *one(160.0, "c")[1:]), one(220.0, "e", None), one(250.0, "f")], [one(161.0, "w", 0.1), one(162.0, "v", None)], None),
    ]
    frame = spark.createDataFrame(rows, f"run_id string, side string, img string, kept array<{box}>, weak array<{box}>, height double")
    frame = frame.withColumns({"width": F.lit(400.0), "bounds_top": F.lit(0.0), "bounds_bottom": F.lit(500.0)})
    got = {r["img"]: r for r in R.run_steps(frame, R.CLEAN + R.GAPS + R.UNION + R.EDGES, "kept", "found").collect()}
    assert not got["none"]["kept"] and not got["empty"]["found"] and got["none"]["height"] is None
    assert [(b["box_id"], b["flags"]) for b in got["holes"]["kept"]] == [("a", []), (None, []), ("w", [K.FLAG_GAP]), ("d", []), ("synthetic:220000", [K.FLAG_GAP_SYNTH]), ("f", [])]


def test_the_chains_read_and_deal_the_boxes_once(spark):
    for name in ("e12_recover_gaps", "e13_recover_edges", "g1_union_recovered", "clean_boxes"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1 and "Window" not in plan and "lambda" not in plan, name
