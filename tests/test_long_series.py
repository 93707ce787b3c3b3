"""Forms for series of any length: small blocks give what the folds and windows over whole series give."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import long_series as L
from gaugeline.operators import profiles as P
from gaugeline.operators import series as S

BLOCK = 16


def profile_rows(seed, lengths=(1, 3, 7, 15, 16, 17, 31, 33, 64, 150, 301)):
    """Waves with ties, plateaus and noise; lengths on both sides of a block's."""
    rng = random.Random(seed)
    rows = []
    for s, n in enumerate(lengths):
        period = rng.choice([3, 5, 9, 21])
        for i in range(n):
            x = round(10 + 6 * np.sin(2 * np.pi * i / period) + rng.choice([0, 0, 0, 1, 3, -4]) * rng.random(), rng.choice([0, 3]))
            rows.append((f"s{s}", i, float(x), 8.0 * i, (i * 37 % 100) / 100.0))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "series string, idx long, x double, y double, conf double")


def points_frame(spark, rows):
    return spark.createDataFrame(rows, "series string, p long")


def random_points(seed, lengths=(1, 2, 3, 16, 17, 40, 130, 333)):
    """Distinct places with regular stretches, close pairs and wide gaps."""
    rng = random.Random(seed)
    out = []
    for s, n in enumerate(lengths):
        p = rng.randrange(5)
        for _ in range(n):
            out.append((f"s{s}", p))
            p += rng.choice([20, 20, 21, 19, 22, 18, 3, 8, 13, 60, 90])
    return out


def as_set(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def close_rows(a, b):
    key = lambda r: tuple(r[:2])
    x, y = sorted(map(tuple, a.collect()), key=key), sorted(map(tuple, b.collect()), key=key)
    assert [key(r) for r in x] == [key(r) for r in y]
    for r, q in zip(x, y):
        for u, v in zip(r[2:], q[2:]):
            assert (u is None) == (v is None) and (u is None or abs(u - v) <= 1e-9 * max(1, abs(u))), (r, q)


WHOLE = 1 << 30


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("distance", [1, 3, 11])
def test_peaks_of_blocks_equal_the_fold(spark, seed, distance):
    df = frame(spark, profile_rows(seed))
    assert as_set(S.local_peaks(df, 9.0, distance, BLOCK)) == as_set(S.local_peaks(df, 9.0, distance, WHOLE))


@pytest.mark.parametrize("late", [False, True])
def test_spacing_of_ties_and_falling_chains(spark, late):
    """A falling row of candidates is decided one after the other, over all blocks."""
    rng = random.Random(3)
    rows = [("fall", i, 1000.0 - i) for i in range(200)] + [("rise", i, float(i)) for i in range(200)] + [("tie", i, 5.0) for i in range(200)]
    rows += [("mixed", i, float(rng.randrange(4))) for i in range(500)]
    got = as_set(L.spaced(spark.createDataFrame(rows, "series string, idx long, x double"), 4, late, BLOCK).select("series", "idx"))
    want = set()
    for name in {r[0] for r in rows}:
        kept = []
        for _, i, _ in sorted((r for r in rows if r[0] == name), key=lambda r: (-r[2], -r[1] if late else r[1])):
            if all(abs(i - k) >= 4 for k in kept):
                kept.append(i)
        want |= {(name, i) for i in kept}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_separators_and_growing_distances(spark, seed):
    df = frame(spark, profile_rows(seed))
    assert as_set(S.separator_pick(df, 3, 4.0, 0.2, BLOCK)) == as_set(S.separator_pick(df, 3, 4.0, 0.2, WHOLE))
    for near, far, start in ((2, 6, 0), (3, 15, 10)):
        assert as_set(S.progressive_peaks(df, 8.0, near, far, start, BLOCK)) == as_set(S.progressive_peaks(df, 8.0, near, far, start, WHOLE))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_walks_equal_the_folds(spark, seed):
    points = points_frame(spark, random_points(seed)).cache()
    periods = points.select("series").distinct().withColumn("period", F.when(F.col("series") == "s5", 5.0).otherwise(20.0))
    gap = lambda most: {r["series"]: r["gap"] for r in S.bounded_median_gap(points, most=most).collect()}
    assert gap(BLOCK) == gap(WHOLE)
    assert as_set(S.fill_missing(points, periods, BLOCK)) == as_set(S.fill_missing(points, periods, WHOLE))
    for min_len in (3, 6, 50):
        short, long = S.best_periodic_run(points, 14, 34, min_len, WHOLE), S.best_periodic_run(points, 14, 34, min_len, BLOCK)
        assert as_set(long[0]) == as_set(short[0]) and as_set(long[1]) == as_set(short[1])
    assert as_set(S.bottom_cluster(points, periods, 600, 3, BLOCK)) == as_set(S.bottom_cluster(points, periods, 600, 3, WHOLE))
    none = periods.limit(0)
    assert as_set(S.bottom_cluster(points, none, 60, 2, BLOCK)) == as_set(S.bottom_cluster(points, none, 60, 2, WHOLE))


@pytest.mark.parametrize("seed", [1, 2])
def test_extensions_equal_the_folds(spark, seed):
    rng = random.Random(seed)
    places, runs, values = [], [], []
    for s, n in enumerate((90, 300, 700, 1200)):
        period = 20
        peaks = sorted({max(0, min(n - 1, i + rng.randrange(-7, 8))) for i in range(0, n, period) if rng.random() < 0.6})
        places += [(f"s{s}", p) for p in peaks]
        middle = n // 2
        runs += [(f"s{s}", middle + k * period) for k in range(-1, 2)]
        values += [(f"s{s}", i, 1.0 if rng.random() < 0.55 else 0.0) for i in range(n)]
    run, points = points_frame(spark, runs), points_frame(spark, places)
    profile = spark.createDataFrame(values, "series string, idx long, x double")
    periods = run.select("series").distinct().withColumn("period", F.when(F.col("series") == "s1", 19.5).when(F.col("series") == "s0", 6.0).otherwise(20.0))
    for low, high in ((0, None), (60, 900)):
        assert as_set(S.extend_periodic(run, points, periods, profile, low, high, 128)) == as_set(S.extend_periodic(run, points, periods, profile, low, high, WHOLE))
    assert as_set(S.extend_supported(run, periods, profile, 0.5, 64)) == as_set(S.extend_supported(run, periods, profile, 0.5, WHOLE))


@pytest.mark.parametrize("seed", [1, 2])
def test_periods_trends_and_corrections(spark, seed):
    df = frame(spark, profile_rows(seed)).cache()
    df = df.withColumn("x", F.when(F.col("idx") % 23 == 5, F.col("x") + 60).otherwise(F.col("x")))
    ranked = lambda most: S.dominant_period(df, 0.05, 0.5, most).select("series", F.lit(0), "period", F.round("strength", 9))
    close_rows(ranked(BLOCK), ranked(WHOLE))
    close_rows(S.trimmed_trend(df, most=BLOCK).select("series", "idx", "trend"), S.trimmed_trend(df, most=WHOLE).select("series", "idx", "trend"))
    for name, run in (("stable", S.stabilise), ("curve", S.consistent_curve), ("repaired", S.repair_low_confidence)):
        close_rows(run(df, BLOCK).select("series", "idx", name), run(df, WHOLE).select("series", "idx", name))


def test_windows_at_the_borders_of_blocks(spark):
    df = frame(spark, profile_rows(4)).cache()
    for made in (
        lambda b: P.moving_average(df, 9, block=b).select("series", "idx", "smooth"), lambda b: P.rolling_median(df, 5, block=b).select("series", "idx", "median"),
        lambda b: P.edge_median(df, 7, block=b).select("series", "idx", "median"),
    ):
        close_rows(made(BLOCK), made(WHOLE))
    dark = df.withColumn("neg", F.col("conf"))
    assert as_set(P.threshold_crossing(dark, 11.0, 5.0, BLOCK)) == as_set(P.threshold_crossing(dark, 11.0, 5.0, WHOLE))


def test_pull_back_gathers_only_what_is_near(spark):
    rows = [("a", i, 100.0 if i < 200 else 20.0, 0.0, 0.0) for i in range(400)] + [("b", i, 50.0, 0.0, 0.0) for i in range(10)]
    df = frame(spark, rows)
    crossing = spark.createDataFrame([("a", 200), ("b", None)], "series string, crossing long")
    candidate = spark.createDataFrame([("a", 220.0), ("b", 7.0)], "series string, candidate double")
    arrays = P.as_arrays(df, "x").join(crossing, "series").join(candidate, "series")
    cut = lambda d: as_set(d.select("series", "crossing", "candidate", "pulled"))
    assert cut(S.pull_back(df, crossing, candidate, 100.0, 20.0)) == cut(P.pull_back(arrays, 100.0, 20.0)) == {("a", 200, 220.0, 200.0), ("b", None, 7.0, 7.0)}


def test_a_series_of_a_million_points(spark):
    """One series is dealt over tasks: peaks, regular runs and gaps end, and agree with a plain loop."""
    n = 1_000_000
    x = np.where(np.arange(n) % 20 == 7, 10.0, 1.0) + (np.arange(n) * 7919 % 101) / 1000.0
    x[400_000:400_300] = 0.0
    wave = F.when(F.col("id") % 20 == 7, 10.0).otherwise(1.0) + (F.col("id") * 7919 % 101) / 1000.0
    df = spark.range(n).select(F.lit("hot").alias("series"), F.col("id").alias("idx"), F.when(F.col("id").between(400_000, 400_299), 0.0).otherwise(wave).alias("x"))
    peaks = S.local_peaks(df, 5.0, 8).cache()
    want = np.flatnonzero(x >= 5)
    assert np.array_equal(np.sort(peaks.toPandas()["p"].to_numpy()), want)
    runs, period = S.best_periodic_run(peaks)
    got = np.sort(runs.toPandas()["p"].to_numpy())
    assert period.first()["run_period"] == 20.0 and np.array_equal(got, want[want >= 400_300])
    filled = S.fill_missing(peaks, spark.createDataFrame([("hot", 20.0)], "series string, period double"))
    assert filled.count() == n // 20
