"""Data sets as many small JSON files."""

import json

from gaugeline.sources import scans


def test_files_are_packed_into_few_tasks_and_read_as_objects_or_lists(spark, tmp_path):
    item = lambda i: {"tube_idx": i, "distance_in": "1.5", "active": True}
    whole = lambda run, side: {"run_id": run, "side": side, "items": [item(1), item(2)]}
    folder = tmp_path / "151"
    folder.mkdir()
    for n in range(40):
        (folder / f"{n}.json").write_text(json.dumps(whole(f"r{n}", "cam_151"), indent=2))
    (folder / "list.json").write_text("﻿" + json.dumps([whole("a", "152"), whole("b", "152")]))
    (folder / "broken.json").write_text('{"run_id": "x", "side": "151", "items": [')
    (folder / "number.json").write_text("7")
    rows = scans.read_sets(spark, str(tmp_path), True)
    assert rows.rdd.getNumPartitions() == 1
    assert {r["run_id"] for r in rows.collect()} == {"a", "b", *(f"r{n}" for n in range(40))}
    assert scans.scan_datasets(spark, str(tmp_path)).count() == 84


def test_a_match_reads_its_files_once(spark):
    from gaugeline.plans import load_all
    from gaugeline.plans.registry import QUERIES

    load_all()
    plan = QUERIES["a4_match_from_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("BatchScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_items_with_headers_are_those_of_both_scans(spark, tmp_path):
    nested = {"y_center_warp": 7.5, "box_xywh": [0, 0, 9, "26"], "source": "yolo_pipe_end"}
    items = [
        {"tube_idx": 1, "distance_in": "1.5", "source_measurement": nested}, {"tube_idx": "x", "distance_in": "n/a", "source_measurement": json.dumps({"box_xyxy": [0, 30, 9, 5.5]})},
        {"distance_in": 2, "y_center_warp": "8", "box_xywh": [1, 2], "box_xyxy": [0, 1, 2, 3], "source_measurement": "none"}, {"source_measurement": "{broken", "y_center_warp": 9, "box_xywh": 5},
    ]
    sets = [
        {"run_id": "a", "side": "151", "items": items, "extra_meta": {"sam_boundary": {"bundle_bounds_y": [9, 3]}, "recovery_bounds_y": {"top": 5, "bottom": 5}, "detection_source": "s", "detection_roi": [1, 2, 3]}},
        {"run_id": "a", "side": "right", "items": items[:1], "extra_meta": {"pipe_end_yolo": {"image_size": {"height": 4}, "postprocess": {"edge_gap_recovery": {"bounds_y": {"y_min": "1", "max_y": 2}}}}}},
        {"run_id": "t", "side": "152", "items": [
            {"source_measurement": {"box_xywh": "[1, 2, 3, 4.5]", "y_center_warp": 6, "source": "classic"}}, {"source_measurement": {"box_xywh": {"a": 1}, "box_xyxy": [0, "2", 1, None, 5], "y_center_warp": 6}},
        ]},
        {"run_id": "b", "side": "152", "items": []}, {"side": "151", "items": items},
    ]
    (tmp_path / "sets.json").write_text(json.dumps(sets))
    rows, heads = scans.scan_datasets(spark, str(tmp_path)), scans.scan_dataset_headers(spark, str(tmp_path))
    assert [(r["y_center"], r["box_height"], r["model_source"]) for r in rows.filter("run_id = 't'").orderBy("position").collect()] == [(6.0, 4.5, False), (6.0, None, False)]
    rows, heads = rows.filter("run_id <> 't'"), heads.filter("run_id IS NULL OR run_id <> 't'")
    measured = {(r["side"], r["position"]): (r["y_center"], r["box_height"], r["model_source"]) for r in rows.collect()}
    assert measured == {
        ("151", 0): (7.5, 26.0, True), ("151", 1): (None, 24.5, False), ("151", 2): (8.0, 2.0, False), ("151", 3): (None, None, False), ("152", 0): (7.5, 26.0, True),
    }
    assert {(r["run_id"], r["side"]): tuple(r)[2:] for r in heads.collect()} == {
        ("a", "151"): (3.0, 9.0, "s", False, None, None, 1.0, 2.0, 3.0, None), ("a", "152"): (1.0, 2.0, None, True, None, 4.0, None, None, None, None),
        ("b", "152"): (None, None, None, False, *[None] * 6), (None, "151"): (None, None, None, False, *[None] * 6),
    }
    both = scans.scan_datasets_with_headers(spark, str(tmp_path)).filter("run_id <> 't'")
    joined = rows.join(heads, ["run_id", "side"])
    assert sorted(map(str, both.select(joined.columns).collect())) == sorted(map(str, joined.collect()))
