"""The match of batches of runs: against the column steps on random runs with ties and unknown values, and where batches end."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import matching as P
from gaugeline.operators import pairing

ITEMS = (
    "run_id string, side string, id string, tube_idx int, source_order int, distance_in double, relative_position string, active boolean, unmatched boolean, "
    "notes string, y_center double, box_height double, model_source boolean"
)
SETS = "run_id string, side string, bounds_top double, bounds_bottom double, detection_source string"


@pytest.fixture(scope="module")
def case(spark):
    items, sets = [], []
    for n in range(80):
        rng = random.Random(n)
        step, total = rng.choice([20, 30]), rng.choice([0, 1, 2, 9, 12, 30])
        for side in ("151", "152"):
            top = rng.choice([None, 10.0, 50.0]) if n % 2 else 10.0
            if rng.random() < 0.9:
                sets.append((f"r{n}", side, top, rng.choice([None, 700.0, 20.0]), "yolo_pipe_end" if n % 3 else rng.choice(["classic", None])))
            y = 40.0
            for i in range(max(0, total + rng.choice([0, 0, 1, -1]))):
                y += rng.choice([step, step, step + 1, 2 * step, 3 * step, 7 * step, 0])
                items.append((
                    f"r{n}", side, f"{side}-{rng.randrange(30) if n % 4 == 0 else i}", rng.choice([i, i, 3, None]), rng.choice([i, 5, None]), rng.choice([1.5, None]), "before",
                    rng.random() < 0.95, rng.choice([False] * 9 + [True]), rng.choice(["", "x"]), None if n % 7 == 0 and rng.random() < 0.2 else y, rng.choice([12.0, 20.0, 0.0, None]), n % 5 == 0,
                ))
    items.append(("idle", "151", "a", 1, 1, 1.0, "after", False, False, "", 1.0, 1.0, True))
    # an id names an item, also where places meet
    items = [(*item[:2], f"{item[2]}/{k}", *item[3:]) for k, item in enumerate(items)]
    return spark.createDataFrame(items, ITEMS).repartition(5).cache(), spark.createDataFrame(sets, SETS).cache()


@pytest.mark.parametrize("chunk", [1, 100, pairing.CHUNK])
def test_a_match_is_what_its_steps_give(spark, case, chunk, monkeypatch):
    monkeypatch.setattr(pairing, "CHUNK", chunk)
    items, sets = case
    rows, headers = P.match_runs(items, sets)
    got = {}
    for r in rows.collect():
        got.setdefault(r["run_id"], []).append(tuple(r))
    strategy = {r["run_id"]: r["strategy"] for r in headers.collect()}
    ordered = P.active_order(items)
    want = {True: {}, False: {}}
    for by_order, found in ((True, P.order_match(ordered)), (False, P.slot_match(P.chosen_slots(ordered, sets)))):
        for r in found.collect():
            want[by_order].setdefault(r["run_id"], []).append((*tuple(r), strategy[r["run_id"]]))
    assert set(strategy) == {r["run_id"] for r in items.select("run_id").distinct().collect()} and "idle" in strategy and "idle" not in got
    for run, chosen in strategy.items():
        assert sorted(got.get(run, []), key=lambda r: r[1]) == sorted(want["order" in chosen].get(run, []), key=lambda r: r[1]), (run, chosen)
    assert len(set(strategy.values())) == 4
    matched = {by_order: {run: sum(r[2] == "matched" for r in found) for run, found in rows.items()} for by_order, rows in want.items()}
    for h in headers.collect():
        assert (h["order_matched"], h["slot_matched"]) == (matched[True].get(h["run_id"], 0), matched[False].get(h["run_id"], 0))


def test_items_with_their_header_match_as_with_sets(case):
    items, sets = case
    carried = items.join(sets, ["run_id", "side"], "left")
    for with_sets, alone in zip(P.match_runs(items, sets), P.match_runs(carried)):
        assert sorted(map(str, with_sets.collect())) == sorted(map(str, alone.collect()))


def test_runs_are_never_cut():
    rng = random.Random(1)
    runs = [run for run in (None, *"abcdefgh") for _ in range(rng.choice([1, 2, 7, 20]))]
    for chunk in (1, 3, 10, 1000):
        for size in (1, 2, 5, 100):
            batches = [pa.RecordBatch.from_pydict({"run_id": pa.array(runs[i:i + size], pa.string())}) for i in range(0, len(runs), size)]
            parts = [b.column("run_id").to_pylist() for b in pairing.whole_runs(iter(batches), chunk)]
            assert sum(parts, []) == runs and all(a[-1] != b[0] for a, b in zip(parts, parts[1:])), (chunk, size)
            assert all(len(part) < chunk + size + 20 for part in parts)
