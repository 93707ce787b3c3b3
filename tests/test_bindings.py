"""Bindings of the driver tables at event numbers that the small tables do not reach."""

import datetime

from gaugeline.plans import load_all, views
from gaugeline.plans.registry import QUERIES

load_all()


def test_a_series_is_all_events_of_a_user(spark, tmp_path):
    start, sf = datetime.datetime(2024, 1, 1), str(tmp_path)
    rows = [(n % 2, n, start + datetime.timedelta(seconds=n), float(n % 7)) for n in range(65_516, 65_556)]
    kinds = "user_id long, event_id long, ts timestamp_ntz, value double"
    spark.createDataFrame(rows, kinds).write.parquet(f"{sf}/events.parquet")
    got = {}
    for r in views.profiles(spark, sf).orderBy("series", "idx").collect():
        got.setdefault(r["series"], []).append((r["idx"], r["value"]))
    want = [[(i, v) for i, v in enumerate(v for u, _, _, v in rows if u == user)] for user in (0, 1)]
    assert list(got.values()) == want
    smooth = {(r["series"], r["idx"]): r["smooth"] for r in QUERIES["d7_moving_average"](spark, sf).collect()}
    for series, values in got.items():
        assert all(smooth[series, i] == round(sum(v for _, v in values[max(0, i - 4):i + 5]) / 9, 6) for i, _ in values)
    assert QUERIES["c17_combine_profiles"](spark, sf).count() == 20
