"""Recovered and split boxes: literal cases worked out by hand, and properties on random stacks."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeline import constants as K
from gaugeline.functions.boxes import from_corners
from gaugeline.operators import boxes as B
from gaugeline.operators import recovery as R

WIDTH, HEIGHT = 400.0, 1000.0
BOX = "run_id string, side string, img string, box_id string, conf double, x1 double, y1 double, x2 double, y2 double"


def frame(spark, rows):
    """Rows (img, name, conf, xc, yc, w, h)."""
    data = [("r", "151", i, n, c, x - w / 2, y - h / 2, x + w / 2, y + h / 2) for i, n, c, x, y, w, h in rows]
    return from_corners(spark.createDataFrame(data, BOX)).withColumn("flags", F.array().cast("array<string>"))


def stack(img, ys):
    return [(img, f"s{n}", 0.9, 200.0, float(y), 26.0, 20.0) for n, y in enumerate(ys)]


def images(spark, names, top=None, bottom=None):
    return spark.createDataFrame([(n, WIDTH, HEIGHT, top, bottom) for n in names], "img string, width double, height double, bounds_top double, bounds_bottom double")


def shown(df):
    found = B.explode_boxes(df, "found").select("img", "b.*").collect()
    return sorted((r["img"], r["box_id"], round(r["yc"], 3), round(r["conf"], 3), tuple(r["flags"])) for r in found)


def test_one_missing_box(spark):
    ys = [100, 130, 190, 220, 250, 280]  # pitch 30, one place empty at 160
    strong = frame(spark, stack("weak", ys) + stack("none", ys) + stack("far", ys))
    weak = frame(spark, [("weak", "w", 0.15, 202.0, 161.0, 24.0, 18.0), ("weak", "weaker", 0.05, 202.0, 160.0, 24.0, 18.0), ("far", "w", 0.15, 202.0, 235.0, 24.0, 18.0)])
    rows = R.recover_gaps(R.recovery_input(strong, weak, images(spark, ["weak", "none", "far"])))
    assert shown(rows) == [
        ("far", "synthetic:160000", 160.0, K.SYNTHETIC_CONF, (K.FLAG_GAP_SYNTH,)), ("none", "synthetic:160000", 160.0, K.SYNTHETIC_CONF, (K.FLAG_GAP_SYNTH,)),
        ("weak", "w", 161.0, 0.15, (K.FLAG_GAP,)),
    ]


def test_two_missing_boxes_stand_evenly(spark):
    rows = R.recover_gaps(R.recovery_input(frame(spark, stack("a", [100, 130, 160, 250, 280, 310])), frame(spark, stack("b", [1])), images(spark, ["a"])))
    assert [(name, y) for _, name, y, _, _ in shown(rows)] == [("synthetic:190000", 190.0), ("synthetic:220000", 220.0)]


def test_regular_stack_and_wide_gap_gain_nothing(spark):
    strong = frame(spark, stack("even", [100, 130, 160, 190]) + stack("wide", [100, 130, 160, 190, 350, 380]))
    rows = R.recover_gaps(R.recovery_input(strong, frame(spark, stack("x", [1])), images(spark, ["even", "wide"])))
    assert shown(rows) == []  # a gap of 160 is over 4.25 pitches


def test_edges_inside_the_bounds(spark):
    strong = frame(spark, stack("a", [300, 330, 360, 390]))
    rows = R.recover_edges(R.recovery_input(strong, frame(spark, stack("x", [1])), images(spark, ["a"], 235.0, 405.0)))
    # above: room for two more, one at half a box from the bound; below: 5 pixels are no room
    found = shown(rows)
    assert [y for _, _, y, _, _ in found] == [245.0, 270.0]
    assert {f for *_, flags in found for f in flags} == {K.FLAG_EDGE_TOP + K.FLAG_EDGE_SYNTH_SUFFIX}


def test_without_bounds_no_edges(spark):
    rows = R.recover_edges(R.recovery_input(frame(spark, stack("a", [300, 330, 360])), frame(spark, stack("x", [1])), images(spark, ["a"])))
    assert shown(rows) == []


@pytest.mark.parametrize("height, n, lowest", [(float("inf"), 2, 120.0), (1000.0, 2, 120.0), (112.0, 2, 112.0), (95.0, 1, 120.0)])
def test_parts_end_at_the_image(spark, height, n, lowest):
    # a box from 70 to 120 among boxes of 20; a part under 7 pixels leaves it whole
    rows = stack("a", [10, 40, 140, 170]) + [("a", "tall", 0.8, 200.0, 95.0, 26.0, 50.0)]
    seps = spark.createDataFrame([("r", "151", "a", "tall", [95.0, 100.0])], "run_id string, side string, img string, box_id string, seps array<double>")
    parts = R.split_oversize(frame(spark, rows), seps.withColumn("seps", F.slice("seps", 1, F.lit(1))), height).filter("box_id LIKE 'tall%'").collect()
    assert len(parts) == n and max(p["y2"] for p in parts) == lowest


def random_case(seed):
    rng = random.Random(seed)
    strong, weak, y, img = [], [], 60.0, f"i{seed}"
    for i in range(22):
        y += rng.choice([28, 30, 33, 62, 95, 140])
        if y > 900:
            break
        strong.append((img, f"s{i}", 0.5 + rng.random() / 2, 200 + rng.uniform(-8, 8), y, rng.uniform(20, 34), rng.uniform(16, 26)))
    for i in range(25):
        weak.append((img, f"w{i}", rng.random() * 0.2, 200 + rng.uniform(-20, 20), rng.uniform(20, 960), rng.uniform(20, 30), rng.uniform(14, 26)))
    return strong, weak


def test_recovered_boxes_are_new_inside_and_never_beside_one_another(spark):
    cases = [random_case(n) for n in range(12)]
    strong, weak = (frame(spark, [r for case in cases for r in case[k]]) for k in (0, 1))
    rows = R.recovery_input(strong, weak, images(spark, [f"i{n}" for n in range(12)], 30.0, 970.0))
    total = 0
    for step in (R.recover_gaps, R.recover_edges):
        for r in step(rows).collect():
            every = [*r["kept"], *r["found"]]
            total += len(r["found"])
            for k, b in enumerate(r["found"]):
                assert 0 <= b["y1"] < b["y2"] <= HEIGHT and 0 <= b["x1"] < b["x2"] <= WIDTH and len(b["flags"]) == 1
                for o in every[: len(r["kept"]) + k]:
                    high = max(0.0, min(b["y2"], o["y2"]) - max(b["y1"], o["y1"]))
                    wide = max(0.0, min(b["x2"], o["x2"]) - max(b["x1"], o["x1"]))
                    assert high / min(b["h"], o["h"]) < 0.7 and high * wide / min(b["w"] * b["h"], o["w"] * o["h"]) < 0.2
    assert total > 40


def test_chain_numbers_what_it_keeps(spark):
    cases = [random_case(n) for n in range(3)]
    strong, weak = (frame(spark, [r for case in cases for r in case[k]]) for k in (0, 1))
    cleaned = R.clean_boxes(strong, weak, images(spark, ["i0", "i1", "i2"], 30.0, 970.0)).collect()
    for n in range(3):
        mine = sorted((r for r in cleaned if r["img"] == f"i{n}"), key=lambda r: r["yc"])
        assert [r["tube_idx"] for r in mine] == list(range(1, len(mine) + 1)) and len(mine) >= len(cases[n][0])
