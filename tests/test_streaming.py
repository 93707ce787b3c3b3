"""Streams with late, repeated and missing rows, and how their batches are dealt."""

import datetime as dt

from gaugeline.plans import load_all
from gaugeline.plans.registry import QUERIES
from gaugeline.streaming import streams

load_all()
START = dt.datetime(2024, 1, 1)
SETS = "run_id string, side string, arrived timestamp, mark int, items array<struct<id: string>>"


def minutes(n):
    return START + dt.timedelta(minutes=n)


def feed(spark, tmp_path, rows, schema, stream, batches):
    """Runs the stream once per part, and returns what each run added."""
    source, checkpoint, seen = str(tmp_path / "in"), str(tmp_path / "cp"), []

    def keep(batch, number):
        seen.extend(tuple(r) for r in batch.collect())

    added = []
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        before = len(seen)
        made = stream(spark.readStream.schema(schema).parquet(source))
        made.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        added.append(sorted(seen[before:], key=str))
    return added


def test_outages_open_close_and_take_late_captures_in_order(spark, tmp_path):
    at = lambda *ms: [("a", minutes(m)) for m in ms]
    # every 10 minutes is expected: 15 without a capture are an outage; rows of up to 10 minutes ago may be late
    parts = [at(0, 10, 22), at(18, 30, 75) + [("b", minutes(70))], at(200), at(230)]
    opened, closed, later, last = feed(spark, tmp_path, parts, "source string, ts timestamp", lambda e: streams.stream_outages(e, 10, "10 minutes"), 4)
    assert opened == []
    # up to minute 65 all is in order; 18 came late and joins the session 0 to 30, which ends in an outage
    assert closed == sorted([("a", "session", minutes(0), minutes(30), 5), ("a", "outage", minutes(30), None, None)], key=str)
    assert later == sorted([
        ("a", "outage", minutes(30), minutes(75), None), ("a", "session", minutes(75), minutes(75), 1), ("a", "outage", minutes(75), None, None),
        ("b", "session", minutes(70), minutes(70), 1), ("b", "outage", minutes(70), None, None),
    ], key=str)
    assert last == sorted([("a", "outage", minutes(75), minutes(200), None), ("a", "session", minutes(200), minutes(200), 1), ("a", "outage", minutes(200), None, None)], key=str)


def test_pairs_are_emitted_once_and_old_sides_expire(spark, tmp_path):
    side = lambda run, which, at, mark: (run, which, minutes(at), mark, [("x",)])
    parts = [
        [side("r1", "151", 0, 1), side("r2", "152", 0, 2), side("old", "151", 0, 3)],
        [side("r1", "151", 5, 4), side("r2", "151", 6, 5)],  # r1 replaces its waiting side, r2 is complete
        [side("r1", "152", 20, 6), side("r2", "151", 21, 7)],  # r1 is complete with the newer side, r2 waits anew
        [side("far", "151", 200, 8)],  # time goes on: what waited more than an hour expires
    ]
    got = feed(spark, tmp_path, parts, SETS, lambda s: streams.stream_pairs(s, "1 hour", "1 minute"), 4)
    marks = [[(r[0], *(None if b is None else int(b.split('"mark":')[1].split(",")[0]) for b in r[1:3]), r[3]) for r in rows] for rows in got]
    assert marks[0] == []
    assert marks[1] == [("r2", 5, 2, False)]
    assert marks[2] == [("r1", 4, 6, False)]
    assert sorted(marks[3]) == [("old", 3, None, True), ("r2", 7, None, True)]


def test_sides_arrive_one_after_the_other_over_many_tasks(spark, monkeypatch):
    seen, plain = [], streams.match_pairs

    def watched(out, body):
        run = plain(out, body)

        def batch_of(batch, number):
            seen.append((batch.count(), batch.rdd.getNumPartitions()))
            run(batch, number)

        return batch_of

    monkeypatch.setattr(streams, "match_pairs", watched)
    assert QUERIES["s5_stream_match"](spark, "/root/testdata/sf0.001").count() > 0
    pairs = [n for n, _ in seen if n]
    # only the last part makes pairs, and all of them in one batch of several tasks
    assert len(pairs) == 1 and all(tasks > 1 for n, tasks in seen if n)


def test_runs_of_one_cell_wait_pair_and_expire_each_for_itself(spark, tmp_path):
    side = lambda run, which, at, mark: (f"r{run}", which, minutes(at), mark, [("x",)])
    left, right, late = range(0, 40), range(0, 40, 2), range(1, 40, 4)
    parts = [
        [side(n, "151", n % 7, n) for n in left],
        [side(n, "152", 20, 100 + n) for n in right],
        [side(n, "152", 59, 100 + n) for n in late],  # the others of the cell have waited for less than an hour by the watermark
        [side("x", "152", 200, 0)],
        [side("y", "151", 300, 0)],
    ]
    got = {}
    for cells in (1, 1 << 14):
        (tmp_path / str(cells)).mkdir()
        got[cells] = feed(spark, tmp_path / str(cells), parts, SETS, lambda s: streams.stream_pairs(s, "1 hour", "1 minute", cells), 4)
    shared = [[(r[0], r[1] is None, r[2] is None, r[3]) for r in rows] for rows in got[1]]
    assert shared[0] == [] and shared[1] == sorted((f"r{n}", False, False, False) for n in right) and shared[2] == sorted((f"r{n}", False, False, False) for n in late)
    assert sorted(sum(shared[3:], [])) == sorted([*((f"r{n}", False, True, True) for n in range(3, 40, 4)), ("rx", True, False, True)])
    assert [sorted(sum(rows[3:], []), key=str) for rows in got.values()][0] == sorted(sum(got[1 << 14][3:], []), key=str) and got[1][:3] == got[1 << 14][:3]
