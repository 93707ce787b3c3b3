"""Small literal cases, properties and skewed input."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gaugeline.functions import scalars as S
from gaugeline.functions.ranking import hash_rank
from gaugeline.operators import boxes as B
from gaugeline.operators import datasets as D
from gaugeline.operators import matching as P
from gaugeline.operators import measure as M
from gaugeline.operators import profiles as R
from gaugeline.plans import views

BOX = "run_id string, side string, img string, box_id string, conf double, x1 double, y1 double, x2 double, y2 double"


def boxes(spark, rows, img="a"):
    from gaugeline.functions.boxes import from_corners

    data = [("r", "151", img, str(i), float(c), *map(float, xy)) for i, (c, *xy) in enumerate(rows)]
    return from_corners(spark.createDataFrame(data, BOX)).withColumn("flags", F.array().cast("array<string>"))


def kept_ids(packed):
    return sorted(r["box_id"] for r in B.unpack(packed).collect())


def centred(conf, x, y, w=20.0, h=20.0):
    return (conf, x - w / 2, y - h / 2, x + w / 2, y + h / 2)


def test_overlap_keeps_confident_then_small(spark):
    packed = B.pack(boxes(spark, [(0.9, 0, 0, 10, 10), (0.5, 0, 5, 10, 15), (0.9, 100, 0, 110, 10), (0.9, 100, 2, 108, 8)]))
    assert kept_ids(packed.withColumn("boxes", B.suppress_overlaps(F.col("boxes")))) == ["0", "3"]


def test_container_removed(spark):
    packed = B.pack(boxes(spark, [(0.9, 0, 0, 100, 100), (0.4, 5, 5, 30, 30), (0.4, 50, 50, 90, 90)]))
    assert kept_ids(packed.withColumn("boxes", B.drop_containers(F.col("boxes")))) == ["1", "2"]


def test_same_band_keeps_one_with_flag(spark):
    packed = B.pack(boxes(spark, [centred(0.6, 10, 50), centred(0.8, 500, 51)]))
    rows = B.unpack(packed.withColumn("boxes", B.collapse_vertical(F.col("boxes")))).collect()
    assert [(r["box_id"], r["flags"]) for r in rows] == [("1", ["kept_vertical_y_duplicate"])]


def test_detached_box_removed(spark):
    stack = [centred(0.5, 10, 30 * i) for i in range(6)] + [centred(0.9, 10, 400)]
    assert B.isolated_clusters(boxes(spark, stack)).filter("box_id = '6'").count() == 0
    assert B.isolated_clusters(boxes(spark, stack)).count() == 6


@pytest.mark.parametrize("conf, verdict", [(0.10, "removed"), (0.60, "kept_far")])
def test_far_box(spark, conf, verdict):
    rows = B.lateral_outliers(boxes(spark, [centred(0.5, 10, 0), centred(conf, 70, 30), centred(0.5, 10, 60)])).collect()
    assert {r["box_id"]: r["verdict"] for r in rows} == {"0": "kept", "1": verdict, "2": "kept"}


@pytest.mark.parametrize("x, decision", [(10.0, "candidate"), (-200.0, "skipped_far_left"), (200.0, "skipped_far_x")])
def test_tall_box(spark, x, decision):
    rows = B.oversize_boxes(boxes(spark, [centred(0.5, 10, 0), centred(0.5, 10, 60, h=60), centred(0.5, x, 120), centred(0.5, 10, 150)]))
    assert rows.filter("box_id = '1'").first()["decision"] == decision


def test_dedupe_leaves_no_pair_above_the_limit(spark):
    rng = random.Random(3)
    rows = [centred(rng.random(), rng.uniform(0, 60), rng.uniform(0, 300), rng.uniform(10, 40), rng.uniform(10, 30)) for _ in range(80)]
    once = B.pack(boxes(spark, rows)).withColumn("boxes", B.suppress_overlaps(F.col("boxes")))
    twice = once.withColumn("boxes", B.suppress_overlaps(F.col("boxes")))
    assert kept_ids(once) == kept_ids(twice)


def item(run, side, i, y, unmatched=False, active=True):
    return (run, side, f"{side}-{i}", i, i, 10.0 + i, "before", active, unmatched, "", y, 20.0)


ITEM = (
    "run_id string, side string, id string, tube_idx int, source_order int, distance_in double, relative_position string, active boolean, "
    "unmatched boolean, notes string, y_center double, box_height double"
)
SET = "run_id string, side string, bounds_top double, bounds_bottom double, detection_source string"


def sets(spark, top=None, bottom=None, source="yolo_pipe_end"):
    return spark.createDataFrame([("r", s, top, bottom, source) for s in ("151", "152")], SET)


def test_regular_sides_match_completely(spark):
    rows = [item("r", s, i, 30.0 * i) for s in ("151", "152") for i in range(1, 46)]
    matched, header = P.match_runs(spark.createDataFrame(rows, ITEM), sets(spark, 0.0, 1400.0))
    assert {r["match_status"] for r in matched.collect()} == {"matched"} and matched.count() == 45
    assert header.first()["strategy"] == "sam_bundle_normalized_vertical_slots"


def test_unmatched_partner_stays_in_slots_and_goes_in_order(spark):
    rows = [item("r", s, i, 30.0 * i, unmatched=(s == "151" and i == 3)) for s in ("151", "152") for i in range(1, 7)]
    ordered = P.active_order(spark.createDataFrame(rows, ITEM))
    slots = P.vertical_slots(ordered).withColumn("queue", -F.col("place"))
    by_slot = P.slot_match(slots).collect()
    by_order = P.order_match(ordered).collect()
    assert "152-3" in {r["id_152"] for r in by_slot} and "152-3" not in {r["id_152"] for r in by_order}


def test_slot_match_keeps_every_item_once(spark):
    rng = random.Random(5)
    rows = [item("r", s, i, rng.uniform(0, 900), unmatched=rng.random() < 0.2, active=rng.random() < 0.9) for s in ("151", "152") for i in range(40)]
    frame = spark.createDataFrame(rows, ITEM)
    slots = P.vertical_slots(P.active_order(frame)).withColumn("queue", -F.col("place"))
    seen = [x for r in P.slot_match(slots).collect() for x in (r["id_151"], r["id_152"]) if x]
    assert sorted(seen) == sorted(r["id"] for r in slots.collect())


def test_items_without_y_use_list_order(spark):
    rows = [item("r", s, i, None) for s in ("151", "152") for i in range(1, 5)]
    slots = P.vertical_slots(P.active_order(spark.createDataFrame(rows, ITEM))).filter("side = '151'")
    assert {r["id"]: r["slot"] for r in slots.collect()} == {f"151-{i}": i for i in range(1, 5)}


def test_detached_top_is_cut(spark):
    rows = [item("r", "151", i, 900.0 - 30.0 * i) for i in range(6)] + [item("r", "151", 9, 100.0)]
    slots = P.vertical_slots(P.active_order(spark.createDataFrame(rows, ITEM))).collect()
    assert "151-9" not in {r["id"] for r in slots} and len(slots) == 6


def test_lengths_in_feet(spark):
    rows = spark.createDataFrame([(492.0,), (491.96,), (None,), (491.5,), (480.25,)], "v double").select(S.format_feet(F.col("v"))).collect()
    assert [r[0] for r in rows] == ["41 - 0", "41 - 0", "-", "40 - 11 & 1/2", "40 - 1/4"]


def test_label_line_errors(spark):
    from gaugeline.sources.scans import validate_labels

    lines = ["0 0.5 0.5 0.1", "1 0.5 0.5 0.1 0.1", "0 1.2 0.5 0.1 0.1", "0 0.5 0.5 0 0.1", "0 0.5 0.5 0.1 0.1", " "]
    rows = validate_labels(spark.createDataFrame([(v,) for v in lines], "value string")).collect()
    assert [r["error"] for r in rows] == ["field_count", "class", "range", "empty", None]


def test_rebase_there_and_back(spark):
    old, new = (0.0, 0.0, 1000.0, 800.0), (-50.0, -40.0, 1100.0, 900.0)
    line = "0 0.500000 0.400000 0.100000 0.050000 0.9"
    moved = spark.createDataFrame([(line,)], "v string").select(M.rebase_line(F.col("v"), old, new).alias("v"))
    back = moved.select(M.rebase_line(F.col("v"), new, old)).first()[0].split()
    assert all(math.isclose(float(a), float(b), abs_tol=2e-6) for a, b in zip(back, line.split()))


@pytest.mark.parametrize("n, train, val", [(7, 7, 7), (10, 8, 2)])
def test_train_val_sizes(spark, n, train, val):
    rows = D.split_train_val(spark.range(n).selectExpr("concat('s', id) AS stem")).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in rows} == {"train": train, "val": val}


def test_ratios_must_add_up(spark):
    with pytest.raises(ValueError):
        D.split_three(spark.range(3).selectExpr("concat('s', id) AS stem"), 0.7, 0.2, 0.2, 1)


def test_rank_is_whole_and_repeatable(spark):
    rows = spark.range(500).selectExpr("id", "if(id % 3 > 0, 'hot', 'cold') AS g")
    a, b = ({r["id"]: r["rank"] for r in hash_rank(d, "id", 1, ["g"]).collect()} for d in (rows, rows.repartition(7)))
    assert a == b
    assert sorted(v for k, v in a.items() if k % 3 > 0) == list(range(1, 334))


def test_calibrations_of_readable_and_broken_files(spark, tmp_path):
    from gaugeline.sources.scans import load_calibrations

    root = tmp_path / "run+1"
    (root / "x").mkdir(parents=True)
    for name, text in {
        "a.toml": 'image_name="a.jpg"\nsrc_points_override=[[1,2],[3.5,2],{x=1,y=9},[4,9]]\n[[points]]\nlabel="t"\nx=5\n[[lines]]\nreal_distance=38.75\n', "a.json": '{"image_name": "twin"}',
        "b.toml": "= broken", "b.json": '{"image_path": "b.png", "dst_rect_override": {"x0": 1, "y0": 2, "x1": 3, "y1": 4}, "rois": [{"xyxy": [1, 2, 3, 4]}, {}]}',
        "c.toml": "= broken", "c.json": "[1]",
    }.items():
        (root / "x" / name).write_text(text)
    got = {r["cal_id"]: r for r in load_calibrations(spark, str(root)).collect()}
    assert sorted(got) == ["x/a", "x/b", "x/c"]
    assert got["x/a"]["image_name"] == "a.jpg" and [tuple(p) for p in got["x/a"]["src_points"]] == [(1.0, 2.0), (3.5, 2.0), (1.0, 9.0), (4.0, 9.0)]
    assert tuple(got["x/a"]["points"][0]) == ("point_01", "mark", "t", 5, 0, "") and got["x/a"]["lines"][0]["real_distance"] == 38.75 and got["x/a"]["rois"] == []
    assert got["x/b"]["image_name"] == "b.png" and got["x/b"]["dst_rect"] == [1.0, 2.0, 3.0, 4.0] and [(r["id"], r["xyxy"]) for r in got["x/b"]["rois"]] == [("roi_01", [1, 2, 3, 4]), ("roi_02", [0, 0, 0, 0])]
    assert got["x/c"]["error"] == "unreadable" and got["x/c"]["points"] is None


def test_images_and_series_follow_from_fixed_widths(spark):
    sf = "/root/testdata/sf0.001"
    runs = views.boxes(spark, sf).select((F.col("l_orderkey") / 16).cast("bigint").cast("string").alias("want"), "run_id")
    assert runs.filter("run_id <> want").count() == 0
    assert views.boxes(spark, sf).groupBy("img").count().agg(F.max("count")).first()[0] <= 256


def test_best_run_and_extension(spark):
    peaks = [5, 40, 60, 81, 100, 111, 120, 300]
    rows = spark.createDataFrame([("s", peaks, 20.0, [0.5] * 400)], "series string, peaks array<bigint>, period double, x array<double>")
    run = R.best_periodic_run(rows, 14, 34, 4)
    assert run.first()["run"] == [40, 60, 81, 100, 120]
    extended = R.extend_periodic(run).first()["extended"]
    assert extended[:3] == [0, 20, 40] or extended[0] >= 0
    assert all(b - a >= 11 for a, b in zip(extended, extended[1:]))


def test_as_of_with_a_hot_key(spark):
    from gaugeline.operators.catalogue import dataset_as_of

    rng = random.Random(2)
    exports = [("u" if i % 3 else "v", 1_000 * rng.randrange(100_000), rng.randrange(10**6), f"e{i}") for i in range(400)]
    matches = [(i, "u" if i % 2 else "v", 1_000 * rng.randrange(100_000), None) for i in range(100)]
    ts = lambda df, c: df.withColumn(c, F.timestamp_millis(c))
    e = ts(spark.createDataFrame(exports, "k string, stamp bigint, mtime bigint, path string"), "stamp")
    m = ts(spark.createDataFrame(matches, "match_id bigint, k string, match_ts bigint, input_path string"), "match_ts")
    got = {r["match_id"]: r["path"] for r in dataset_as_of(m, e, "k").collect()}
    for i, k, at, _ in matches:
        mine = [(mt, p, st) for kk, st, mt, p in exports if kk == k]
        before = [x for x in mine if x[2] <= at]
        assert got[i] == max(before or mine)[1]


def test_extension_walks_as_far_as_the_profile_supports(spark):
    rows = spark.createDataFrame(
        [("s", [500, 510, 520], [500, 510, 520], 10.0, [1.0] * 1500)], "series string, peaks array<bigint>, run array<bigint>, period double, x array<double>"
    )
    assert R.extend_periodic(rows).first()["extended"] == list(range(0, 1500, 10))
    assert R.extend_periodic(rows, y_min=300, y_max=700).first()["extended"] == list(range(300, 701, 10))


def test_extension_stops_where_support_ends_and_snaps_to_peaks(spark):
    profile = [0.0] * 100 + [1.0] * 100 + [0.0] * 100
    rows = spark.createDataFrame(
        [("s", [87, 140, 160], [140, 160], 20.0, profile)], "series string, peaks array<bigint>, run array<bigint>, period double, x array<double>"
    )
    # up: 120 and 100 stand on the profile, 80 snaps to the peak at 87, 67 has neither; down: 180, then nothing holds 200
    assert R.extend_periodic(rows).first()["extended"] == [87, 100, 120, 140, 160, 180]


@pytest.mark.parametrize("peaks, run, period", [
    ([0, 20, 58], [0, 20, 58], 29.0),  # no regular run: all peaks, gaps of 12 to 40 count
    ([0, 15, 30, 45, 200], [0, 15, 30, 45], 15.0),
    ([0, 15, 30, 100, 120, 140], [0, 15, 30], 15.0),  # equally long runs: the first
    ([0, 5, 15, 30, 100], [0, 15, 30], 15.0),  # a close peak is passed over
])
def test_best_run(spark, peaks, run, period):
    rows = spark.createDataFrame([("s", peaks)], "series string, peaks array<bigint>")
    got = R.best_periodic_run(rows, 14, 34, 3).first()
    assert (got["run"], got["run_period"]) == (run, period)


@pytest.mark.parametrize("n, kept", [(10, 10), (7, 10)])
def test_bottom_cluster(spark, n, kept):
    top, low = [10, 60, 110], [230 + 20 * i for i in range(n)]
    rows = spark.createDataFrame([("s", top + low, 20.0)], "series string, peaks array<bigint>, period double")
    assert R.bottom_cluster(rows, 500).first()["cluster"] == (top + low)[-kept:]


def test_as_of_without_times(spark):
    from gaugeline.operators.catalogue import dataset_as_of

    at = lambda df, c: df.withColumn(c, F.timestamp_millis(c))
    exports = at(spark.createDataFrame([("u", 10, 5, "e1"), ("u", 20, 9, "e3"), ("u", None, 99, "nostamp")], "k string, stamp bigint, mtime bigint, path string"), "stamp")
    matches = at(spark.createDataFrame([
        (1, "u", 15, None), (2, "u", None, None), (3, "u", 5, "d/latest.json"), (4, "u", 15, "d/my_latest.json"), (5, "v", 15, "d/LATEST.json"), (6, "v", 15, None), (7, "w", 15, None),
    ], "match_id bigint, k string, match_ts bigint, input_path string"), "match_ts")
    latest = spark.createDataFrame([("v", "newest_v")], "k string, path string")
    got = {r["match_id"]: (r["path"], r["how"]) for r in dataset_as_of(matches, exports, "k", latest=latest).collect()}
    assert got == {
        1: ("e1", "as_of"), 2: ("e3", "newest"), 3: ("e3", "newest"), 4: ("d/my_latest.json", "given"), 5: ("d/LATEST.json", "input"),
        6: ("newest_v", "latest"), 7: (None, "none"),
    }


def test_both_forms_of_clipping(spark):
    images = spark.createDataFrame([("a", 100, 100)], "img string, width int, height int")
    sized = spark.createDataFrame([("a", "1", -10.0, 10.0, 30.0, 20.0, 20.0, 0.5)], "img string, box_id string, x double, y double, w double, h double, yc double, conf double")
    assert D.label_texts(sized, images).first()["text"] == "0 0.150000 0.200000 0.300000 0.200000\n"
    corners = sized.selectExpr("img", "box_id", "x AS x1", "y AS y1", "x + w AS x2", "y + h AS y2", "yc", "conf")
    assert D.label_texts(corners, images).first()["text"] == "0 0.100000 0.200000 0.200000 0.200000\n"
    assert M.clip_sized(sized, images).select("x", "w").first() == (0.0, 30.0)


def test_run_without_active_items_has_a_header(spark):
    columns = "run_id string, side string, id string, tube_idx int, source_order int, distance_in double, offset_px double, relative_position string, active boolean, unmatched boolean, notes string, y_center double, box_height double, ref_x double"
    items = spark.createDataFrame([(run, side, f"{side}{i}", i, i, 5.0, 1.0, None, run == "2", False, "", 40.0 * i, 20.0, 610.0) for run in "12" for side in ("151", "152") for i in (1, 2)], columns)
    sets = spark.createDataFrame([(r, s, None, None, "classic", None, None, None, None, None, None) for r in "12" for s in ("151", "152")],
                                 "run_id string, side string, bounds_top double, bounds_bottom double, detection_source string, image_w double, image_h double, roi_x double, roi_y double, roi_w double, roi_h double")
    rows, header = P.match_runs(items, sets)
    assert {r["run_id"]: (r["n151"], r["n152"], r["slot_matched"]) for r in header.collect()} == {"1": (0, 0, 0), "2": (2, 2, 2)}
    assert {r["run_id"] for r in rows.collect()} == {"2"}


def test_known_pairs_scale_the_left_camera_only(spark):
    from gaugeline.operators import calibration as A

    points = spark.createDataFrame([(c, n, label, 155.0 * n, 10.0) for c in ("l", "r") for n, label in enumerate(("top_03", "top_04"))], "cal_id string, position int, label string, x double, y double")
    unit = spark.createDataFrame([(c, side, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0) for c, side in (("l", "151"), ("r", "152"))], "cal_id string, side string, " + ", ".join(f"{h} double" for h in A.MATRIX))
    assert [(r["cal_id"], r["distance_px"]) for r in A.known_distance_pairs(points, unit).collect()] == [("l", 155.0)]


def test_degenerate_quads_have_no_matrix(spark):
    from gaugeline.operators import calibration as A

    names = [c + a for c in ("tl", "tr", "bl", "br") for a in "xy"]
    good, flat = [0.0, 0.0, 400.0, 0.0, 0.0, 500.0, 400.0, 500.0], [0.0, 0.0, 400.0, 0.0, 0.0, 20.0, 400.0, 20.0]
    cases = [("good", *good, None, None, None, None), ("flat", *flat, None, None, None, None), ("thin", *good, 0.0, 0.0, 20.0, 499.0)]
    quads = spark.createDataFrame(cases, "cal_id string, " + ", ".join(f"{n} double" for n in names) + ", rx0 double, ry0 double, rx1 double, ry1 double").withColumns({"exact": F.lit(True), "mirror": F.lit(False)})
    got = {r["cal_id"]: (r["error"], r["h11"] is None) for r in A.fit_homography(quads).collect()}
    assert got == {"good": (None, False), "flat": ("degenerate", True), "thin": ("degenerate", True)}


def test_last_item_of_a_repeated_number_is_compared(spark):
    items = spark.createDataFrame([("r", "151", 1, 0, 5.0, None), ("r", "151", 1, 1, 7.0, None)], "run_id string, side string, tube_idx int, source_order int, distance_in double, relative_position string")
    points = spark.createDataFrame([("r", 1, 10.0, 0.0, None, None)], "run_id string, tube_number int, x_151 double, y_151 double, x_152 double, y_152 double")
    names = [f"{c}_{s}" for s in ("151", "152") for c in ("lx0", "ly0", "lx1", "ly1", "const_x", "px_per_in")]
    sides = spark.createDataFrame([("r", *[None if n.startswith("l") else 2.0 for n in names])], "run_id string, " + ", ".join(f"{n} double" for n in names))
    rows = P.manual_compare(points, sides, items).collect()
    assert [(r["algorithm_151"], r["manual_151"]) for r in rows] == [(7.0, 4.0)]


def test_band_duplicates_are_counted_apart(spark):
    stack = [centred(0.6, 10, 50), centred(0.8, 500, 51), centred(0.5, 10, 90), centred(0.9, 12, 93)]
    counts = B.suppression_audit(B.pack(boxes(spark, stack))).first()
    assert (counts["suppressed_vertical_y_duplicate"], counts["final_count"]) == (1, 2)


def test_unreadable_numbers_are_no_boxes(spark):
    from gaugeline.sources.scans import parse_labels, validate_labels

    lines = spark.createDataFrame([("0 0.5 0.5 0.1 0.2",), ("0 x 0.5 0.1 0.2",), ("0 0.5 0.5 0.1 0.2 0.9",), ("1 0.5 0.5 0.1 0.2",)], "value string")
    assert sorted((r["xn"], r["conf"] or 0) for r in parse_labels(lines).collect()) == [(0.5, 0), (0.5, 0.9)]
    assert [r["error"] for r in validate_labels(lines).filter("error = 'number'").collect()] == ["number"]


def test_paths_below_a_root_with_signs(spark):
    from gaugeline.sources.scans import relative

    cases = [("file:/data/run+1/a/b.txt", "/data/run+1", "a/b.txt"), ("file:///d/x/x/b.txt", "file:///d/x", "x/b.txt"), ("hdfs://h:1/d/r (2)/c.txt", "hdfs://h:1/d/r (2)/", "c.txt"),
             ("file:/d/r%20(2)/c.txt", "/d/r (2)", "c.txt")]
    for path, root, want in cases:
        assert spark.createDataFrame([(path,)], "p string").select(relative(F.col("p"), root)).first()[0] == want


def test_late_candidate_is_pulled_back(spark):
    falling = [100.0] * 80 + [20.0] * 60
    cases = [("far", falling, 110.0, 80), ("near", falling, 84.0, 80), ("mid", falling, 90.0, 80), ("none", falling, 110.0, None), ("flat", [60.0] * 140, 110.0, 80)]
    rows = spark.createDataFrame(cases, "series string, x array<double>, candidate double, crossing bigint")
    got = {r["series"]: r["pulled"] for r in R.pull_back(rows, 100.0, 20.0).collect()}
    assert got["far"] == 80.0 and got["near"] == 84.0 and got["none"] == 110.0 and got["flat"] == 110.0
    assert math.isclose(got["mid"], 0.85 * 80 + 0.15 * 90)
