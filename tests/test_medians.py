"""Exact medians by radix selection."""

import math
import random
import statistics

import pytest

from gaugeline.functions.quantiles import exact_median, with_order_bits
from pyspark.sql import functions as F


def wide(n, seed):
    """Values of all sizes and signs, with ties, both zeros and the smallest and largest doubles."""
    rng = random.Random(seed)
    out = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1e-300, 1e300, -1e300, 1.7976931348623157e308]
    while len(out) < n:
        v = rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randrange(-320, 308)
        out += [v] * rng.choice([1, 1, 1, 4])
    return out[:n]


def test_bits_keep_the_order(spark):
    values = sorted(set(wide(3000, 1) + [2.0**k for k in range(-1074, 1024, 3)] + [math.nextafter(2.0**k, 0) for k in range(-1020, 1024, 7)] + [-math.inf, math.inf]))
    rows = spark.createDataFrame([(v,) for v in values], "v double").transform(with_order_bits, "v", "b").collect()
    bits = {r["v"]: r["b"] for r in rows}
    assert all(bits[a] < bits[b] for a, b in zip(values, values[1:]))
    assert spark.createDataFrame([(0.0,), (-0.0,)], "v double").transform(with_order_bits, "v", "b").select("b").distinct().count() == 1


@pytest.mark.parametrize("n", [1, 2, 3, 40, 999, 4000])
def test_median_of_values_of_all_sizes(spark, n):
    groups = {"hot": wide(n, n), "b": [1.5, None, 2.5], None: [7.0], "none": [None]}
    rows = [(k, v) for k, values in groups.items() for v in values]
    random.Random(0).shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, x double")
    for few in (10_000, 0):  # buckets of few groups are broadcast, those of many are not
        got = {r["k"]: (r["median"], r["total"]) for r in exact_median(frame, ["k"], value="x", few=few).collect()}
        s = sorted(groups["hot"])
        assert got == {"hot": (0.5 * (s[(n - 1) // 2] + s[n // 2]), n), "b": (2.0, 2), None: (7.0, 1)}


def test_weights_count_rows(spark):
    rows = [("a", 1.0, 3), ("a", 2.0, 2), ("a", 9.0, 1), ("b", 4.0, 1), ("b", -6.0, 1)]
    got = {r["k"]: r["m"] for r in exact_median(spark.createDataFrame(rows, "k string, v double, n int"), ["k"], "m", weight="n").collect()}
    assert got == {"a": statistics.median([1, 1, 1, 2, 2, 9]), "b": -1.0}


def test_no_step_depends_on_the_values_of_one_group(spark):
    """Windows see histograms, which are bounded; values themselves are neither sorted nor dealt by group."""
    frame = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    plan = exact_median(frame, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Window")]
    assert "Aggregate" in plan[plan.index("Window"):] and "percentile" not in plan and "collect_list" not in above


def test_an_empty_table(spark):
    assert exact_median(spark.createDataFrame([], "k string, v double"), ["k"]).count() == 0
