"""One-dimensional profiles: smoothing, peaks, periods, trends, edges.

Rows are (series, idx, x), idx from 0 without holes.  Sliding windows run per block of a series whose
borders are copied from its neighbours, so a series may have any length.  Forms that fold or sort a whole
series are for short ones; `operators.series` takes series of any length and hands the short ones to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators.long_series import BLOCK, inner, spread

SERIES = "PARTITION BY series"
ORDER = "PARTITION BY series ORDER BY idx"
BLOCKED = "PARTITION BY series, _block ORDER BY idx"


def around(before: int, after: int, order: str = ORDER) -> str:
    start = f"{before} PRECEDING" if before > 0 else (f"{-before} FOLLOWING" if before < 0 else "CURRENT ROW")
    end = f"{after} FOLLOWING" if after > 0 else (f"{-after} PRECEDING" if after < 0 else "CURRENT ROW")
    return f"({order} ROWS BETWEEN {start} AND {end})"


def moving_average(df: DataFrame, window: int, name: str = "smooth", block: int = BLOCK) -> DataFrame:
    """Box filter with zeros beyond the ends; the divisor stays k."""
    k = max(3, int(window))
    k += 1 - k % 2
    rows = spread(df, k // 2, k // 2, block)
    return inner(rows.withColumn(name, F.expr(f"sum(x) OVER {around(k // 2, k // 2, BLOCKED)} / {k}D")), block)


def minmax01(df: DataFrame, value: str = "x", name: str = "unit") -> DataFrame:
    low, high = f"min({value}) OVER ({SERIES})", f"max({value}) OVER ({SERIES})"
    return df.withColumn(name, F.expr(f"({value} - {low}) / (({high} - {low}) + 1e-6D)"))


def max_norm(df: DataFrame, value: str = "x", name: str = "scaled") -> DataFrame:
    return df.withColumn(name, F.expr(f"{value} / (max({value}) OVER ({SERIES}) + 1e-6D)"))


def spaced(candidates: str, distance: str) -> str:
    """Fold text: of (neg value, idx) entries in order, keep those far enough from all kept."""
    return (
        f"aggregate(array_sort({candidates}), cast(array() as array<bigint>), (kept, c) -> "
        f"if(exists(kept, k -> abs(k - c.idx) < {distance}), kept, concat(kept, array(c.idx))))"
    )


def local_peaks(df: DataFrame, threshold: float, min_distance: int) -> DataFrame:
    """Peaks per series, strongest first with a minimum spacing: (series, peaks)."""
    peak = f"x >= {threshold}D AND x >= lag(x) OVER ({ORDER}) AND x > lead(x) OVER ({ORDER})"
    found = df.withColumn("is_peak", F.expr(peak)).groupBy("series").agg(
        F.expr("collect_list(CASE WHEN is_peak THEN struct(-x AS v, idx AS idx) END)").alias("c")
    )
    return found.select("series", F.expr(f"array_sort({spaced('c', str(max(1, min_distance)))})").alias("peaks"))


def rolling_median(df: DataFrame, radius: int, name: str = "median", value: str = "x", block: int = BLOCK) -> DataFrame:
    """Median of the neighbourhood, cut at the ends."""
    r = max(1, radius)
    return inner(spread(df, r, r, block).withColumn(name, near_median(r, value, BLOCKED)), block)


def near_median(radius: int, value: str = "x", order: str = ORDER) -> Column:
    return F.expr(f"percentile({value}, 0.5) OVER {around(radius, radius, order)}")


def edge_median(df: DataFrame, window: int, name: str = "median", value: str = "x", block: int = BLOCK) -> DataFrame:
    """Median of an odd window with the end values repeated."""
    pad = (max(1, int(window)) + 1 - max(1, int(window)) % 2) // 2
    return inner(smoothed(spread(df, pad, pad, block), window, name, value, BLOCKED), block)


def smoothed(df: DataFrame, window: int, name: str, value: str, order: str = ORDER) -> DataFrame:
    """The edge median in windows of `order`; a block's borders must hold half a window."""
    k = max(1, int(window))
    k += 1 - k % 2
    pad = k // 2
    reach = ", ".join(
        f"coalesce({'lag' if d < 0 else 'lead'}({value}, {abs(d)}) OVER ({order}), "
        f"{'first' if d < 0 else 'last'}({value}) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
        if d else value
        for d in range(-pad, pad + 1)
    )
    return df.withColumn("_near", F.expr(f"array({reach})")).withColumn(name, F.expr(f"sort_array(_near)[{pad}]")).drop("_near")


def true_ranges(df: DataFrame, test: str, min_len: int) -> DataFrame:
    """Ranges of consecutive idx where the test holds: (series, start, end)."""
    hits = df.filter(F.expr(test)).withColumn("island", F.expr(f"idx - row_number() OVER ({ORDER})"))
    ranges = hits.groupBy("series", "island").agg(F.min("idx").alias("start"), F.max("idx").alias("end"))
    return ranges.filter(F.col("end") - F.col("start") + 1 >= min_len).drop("island")


def merge_ranges(ranges: DataFrame, max_gap: int) -> DataFrame:
    """Joins ranges whose distance is at most max_gap."""
    before = "max(end) OVER (PARTITION BY series ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    marked = ranges.withColumn("opens", F.expr(f"CASE WHEN start - {before} <= {max_gap} THEN 0 ELSE 1 END"))
    grouped = marked.withColumn("g", F.expr("sum(opens) OVER (PARTITION BY series ORDER BY start)"))
    return grouped.groupBy("series", "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")


def best_range(ranges: DataFrame, df: DataFrame) -> DataFrame:
    """The range with the largest length times median value; the first one on ties."""
    inside = ranges.join(df, "series").filter(F.col("idx").between(F.col("start"), F.col("end")))
    scored = inside.groupBy("series", "start", "end").agg(
        ((F.col("end") - F.col("start") + 1) * F.median("x")).alias("score")
    )
    return scored.groupBy("series").agg(F.expr("max_by(struct(start, end, score), struct(score, -start))").alias("r")).select("series", "r.*")


def full_range(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("series").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def as_arrays(df: DataFrame, *values: str) -> DataFrame:
    """One row per series with its values in order."""
    fields = ", ".join(["idx", *[v for v in values if v != "idx"]])
    packed = df.groupBy("series").agg(F.expr(f"array_sort(collect_list(struct({fields})))").alias("_p"))
    return packed.select("series", *[F.expr(f"transform(_p, p -> p.{v})").alias(v) for v in values])


def dominant_period(df: DataFrame, low: float = 0.02, high: float = 0.50) -> DataFrame:
    """Lag of the largest autocorrelation within a share of the length; null under 8 points."""
    rows = as_arrays(df, "x").withColumn("n", F.size("x"))
    rows = rows.withColumn("x", F.expr("transform(x, v -> v - aggregate(x, 0D, (a, b) -> a + b) / n)"))
    rows = rows.withColumn("lo", F.expr(f"greatest(4, cast(rint({low}D * n) AS int))")).withColumn(
        "hi", F.expr(f"least(n, greatest(lo + 1, cast(rint({high}D * n) AS int)))")
    )
    product = "aggregate(zip_with(slice(x, 1, n - k), slice(x, k + 1, n - k), (a, b) -> a * b), 0D, (s, p) -> s + p)"
    power = "(aggregate(x, 0D, (s, v) -> s + v * v) + 1e-9D)"
    scored = rows.withColumn("power", F.expr(power)).withColumn(
        "best",
        F.expr(f"array_max(transform(filter(sequence(lo, greatest(lo, hi - 1)), k -> k < hi AND k < n), k -> struct({product} / power AS r, -k AS k)))"),
    )
    return scored.select("series", F.expr("CASE WHEN n >= 8 THEN cast(-best.k AS double) END").alias("period"), F.expr("CASE WHEN n >= 8 THEN best.r END").alias("strength"))


# Peak arrays: rows (series, peaks array<bigint>, period double) ------------------------------


def bounded_median_gap(peaks: str = "peaks", low: float = 12.0, high: float = 40.0) -> Column:
    steps = f"zip_with(slice({peaks}, 2, greatest(size({peaks}) - 1, 0)), slice({peaks}, 1, greatest(size({peaks}) - 1, 0)), (b, a) -> cast(b - a AS double))"
    kept = f"array_sort(filter({steps}, g -> g >= {low}D AND g <= {high}D))"
    middle = "0.5D * (get(s, cast((size(s) - 1) div 2 AS int)) + get(s, cast(size(s) div 2 AS int)))"
    return F.expr(f"CASE WHEN size({peaks}) >= 3 THEN get(transform(array({kept}), s -> CASE WHEN size(s) > 0 THEN {middle} END), 0) END")


def thin(points: str, distance: str) -> str:
    """Fold text: drop points closer than the distance to the last kept one."""
    return (
        f"aggregate({points}, cast(array() AS array<bigint>), (kept, p) -> "
        f"if(size(kept) = 0 OR p - element_at(kept, -1) >= {distance}, concat(kept, array(p)), kept))"
    )


SEPARATION = "greatest(10, cast(rint(0.55D * period) AS int))"


def fill_missing(df: DataFrame) -> DataFrame:
    """Fill gaps above 1.65 periods evenly, then drop points that are too close."""
    missing = "(cast(rint((p - last) / period) AS int) - 1)"
    between = (
        f"if(p - last > 1.65D * period AND {missing} > 0, transform(sequence(1, greatest(1, {missing})), "
        f"j -> cast(rint(last + (p - last) / ({missing} + 1D) * j) AS bigint)), cast(array() AS array<bigint>))"
    )
    step = f"get(transform(array(element_at(acc, -1)), last -> concat(acc, {between}, array(p))), 0)"
    filled = f"aggregate(slice(peaks, 2, size(peaks)), slice(peaks, 1, 1), (acc, p) -> {step})"
    usable = "size(peaks) >= 2 AND period >= 8D"
    return df.withColumn("_filled", F.expr(f"CASE WHEN {usable} THEN {filled} END")).withColumn(
        "peaks", F.expr(f"CASE WHEN {usable} THEN {thin('_filled', SEPARATION)} ELSE peaks END")
    ).drop("_filled")


def best_periodic_run(df: DataFrame, low: int = 14, high: int = 34, min_len: int = 6) -> DataFrame:
    """Longest run of peaks with regular gaps, the earliest on ties; else all peaks."""
    state = "named_struct('run', array(s), 'open', true)"
    step = (
        f"CASE WHEN acc.open AND p - element_at(acc.run, -1) BETWEEN {low} AND {high} THEN named_struct('run', concat(acc.run, array(p)), 'open', true) "
        f"WHEN acc.open AND p - element_at(acc.run, -1) > {high} THEN named_struct('run', acc.run, 'open', false) ELSE acc END"
    )
    runs = f"transform(peaks, (s, i) -> aggregate(slice(peaks, i + 2, size(peaks)), {state}, (acc, p) -> {step}).run)"
    best = f"array_max(transform(filter({runs}, r -> size(r) >= {min_len}), r -> struct(size(r) AS n, -r[0] AS first, r AS run))).run"
    rows = df.withColumn("run", F.expr(f"CASE WHEN size(peaks) >= {min_len} THEN {best} END"))
    # a regular run has its own band; without one, all peaks count with the general band
    period = F.when(F.col("run").isNotNull(), bounded_median_gap("run", float(low), float(high))).otherwise(bounded_median_gap("peaks"))
    return rows.withColumn("run_period", period).withColumn("run", F.coalesce("run", "peaks"))


def bottom_cluster(df: DataFrame, height: int, min_peaks: int = 8) -> DataFrame:
    """Peaks from the start of the longest regular run in the lower part; else all of them."""
    steps = "transform(sequence(1, greatest(size(peaks) - 1, 1)), i -> get(peaks, i) - get(peaks, i - 1))"
    rows = df.withColumn("_p", F.expr(f"coalesce(period, get(transform(array(array_sort({steps})), s -> 0.5D * (get(s, cast((size(s) - 1) div 2 AS int)) + get(s, cast(size(s) div 2 AS int)))), 0))"))
    rows = rows.withColumn("_lo", F.expr("greatest(12, cast(floor(0.75D * _p) AS int))")).withColumn("_hi", F.expr("greatest(_lo + 1, cast(ceil(1.15D * _p) AS int))"))
    grow = (
        "aggregate(sequence(1, greatest(size(peaks) - 1, 1)), named_struct('start', 0, 'runs', cast(array() AS array<struct<n:int,y:bigint,i:int>>)), (acc, i) -> "
        "CASE WHEN get(peaks, i) - get(peaks, i - 1) BETWEEN _lo AND _hi THEN named_struct('start', acc.start, 'runs', "
        "concat(acc.runs, array(named_struct('n', i - acc.start + 1, 'y', get(peaks, acc.start), 'i', acc.start)))) "
        "ELSE named_struct('start', i, 'runs', acc.runs) END).runs"
    )
    floor_y = round(0.45 * height)
    best = f"array_max(filter({grow}, r -> r.n >= {min_peaks} AND r.y >= {floor_y}))"
    rows = rows.withColumn("_b", F.expr(f"CASE WHEN size(peaks) >= {min_peaks} THEN {best} END"))
    return rows.withColumn("cluster", F.expr("CASE WHEN _b IS NULL THEN peaks ELSE slice(peaks, _b.i + 1, size(peaks)) END")).drop("_p", "_lo", "_hi", "_b")


def extend_periodic(df: DataFrame, y_min: int = 0, y_max: int | None = None) -> DataFrame:
    """Extend a run up and down by one period at a time.

    Rows hold run, peaks (observed), period and the normalised profile x.  A step snaps to
    an observed peak nearby or takes the predicted place when the profile supports it. The walk
    ends by these rules alone: a step moves by the separation at least, so the length of the
    profile over the separation bounds their number.
    """
    rows = df.withColumn("_sep", F.expr(SEPARATION)).withColumn("_snap", F.expr("greatest(5, cast(rint(0.40D * period) AS int))"))
    rows = rows.withColumn("_sorted", F.array_sort("x")).withColumn("_pos", F.expr("0.55D * (size(x) - 1)")).withColumn(
        "_support",
        F.expr("greatest(0.16D, get(_sorted, cast(floor(_pos) AS int)) + (_pos - floor(_pos)) * (get(_sorted, cast(ceil(_pos) AS int)) - get(_sorted, cast(floor(_pos) AS int))))"),
    )
    near = "array_min(transform(filter(peaks, q -> abs(q - g) <= _snap), q -> struct(abs(q - g) AS d, q AS q))).q"
    snap = f"coalesce({near}, CASE WHEN g BETWEEN 0 AND size(x) - 1 AND get(x, cast(g AS int)) >= _support THEN g END)"

    def walk(sign: int, limit: str) -> str:
        edge = "element_at(acc.out, -1)"
        guess = f"cast(rint({edge} + {sign} * period) AS bigint)"
        target = f"get(transform(array({guess}), g -> CASE WHEN {limit} THEN {snap} END), 0)"
        take = f"CASE WHEN t IS NULL OR {sign} * (t - {edge}) < _sep THEN named_struct('out', acc.out, 'open', false) ELSE named_struct('out', concat(acc.out, array(t)), 'open', true) END"
        step = f"CASE WHEN acc.open THEN get(transform(array({target}), t -> {take}), 0) ELSE acc END"
        start = "run[0]" if sign < 0 else "element_at(run, -1)"
        steps = "cast(size(x) div _sep + 1 AS int)"
        return f"slice(aggregate(sequence(1, {steps}), named_struct('out', array({start}), 'open', true), (acc, i) -> {step}).out, 2, {steps})"

    top = "size(x) - 1" if y_max is None else f"least(size(x) - 1, {y_max})"
    usable = "size(run) > 0 AND period >= 8D"
    rows = rows.withColumn("_up", F.expr(f"CASE WHEN {usable} THEN {walk(-1, f'g >= {y_min}')} END")).withColumn(
        "_down", F.expr(f"CASE WHEN {usable} THEN {walk(1, f'g <= {top}')} END")
    )
    joined = "concat(reverse(_up), run, _down)"
    return rows.withColumn("extended", F.expr(f"CASE WHEN {usable} THEN {thin(joined, '_sep')} ELSE run END")).drop(
        "_sep", "_snap", "_sorted", "_pos", "_support", "_up", "_down"
    )


def extend_supported(df: DataFrame, support: float) -> DataFrame:
    """Up to four more points above and two below while the band around them is supported."""
    rows = df.withColumn("_half", F.expr("greatest(4, cast(rint(0.22D * period) AS int))"))
    band = "slice(x, greatest(0, cast(g AS int) - _half) + 1, least(size(x) - 1, cast(g AS int) + _half) - greatest(0, cast(g AS int) - _half) + 1)"
    strength = f"aggregate({band}, 0D, (s, v) -> s + v) / size({band})"

    def walk(sign: int, steps: int) -> str:
        guess = f"cast(rint(element_at(acc.out, -1) + {sign} * period) AS bigint)"
        ok = f"g >= 0 AND g < size(x) AND {strength} >= {support}D"
        step = f"get(transform(array({guess}), g -> CASE WHEN acc.open AND {ok} THEN named_struct('out', concat(acc.out, array(g)), 'open', true) ELSE named_struct('out', acc.out, 'open', false) END), 0)"
        start = "run[0]" if sign < 0 else "element_at(run, -1)"
        return f"slice(aggregate(sequence(1, {steps}), named_struct('out', array({start}), 'open', true), (acc, i) -> {step}).out, 2, {steps})"

    usable = "size(run) > 0 AND period > 0D"
    return rows.withColumn("extended", F.expr(f"CASE WHEN {usable} THEN concat(reverse({walk(-1, 4)}), run, {walk(1, 2)}) ELSE run END")).drop("_half")


def pair_bands(points: DataFrame, low: float, high: float, inside: str = "false") -> DataFrame:
    """Consecutive seams (series, y) to bands; rejected ones carry the reason."""
    rows = points.withColumn("to_y", F.expr("lead(y) OVER (PARTITION BY series ORDER BY y)")).filter(F.col("to_y").isNotNull())
    return rows.withColumn("distance", F.col("to_y") - F.col("y")).withColumn(
        "reason",
        F.expr(f"CASE WHEN distance BETWEEN {low} AND {high} OR ({inside}) THEN NULL WHEN distance > {high} THEN 'alto' ELSE 'bajo' END"),
    )


# Positions along a stack: rows (series, idx, y, x) ------------------------------------------


def line_fit(value: str, where: str) -> tuple[str, str]:
    y, x = f"CASE WHEN {where} THEN {value} END", f"CASE WHEN {where} THEN y END"
    return f"regr_slope({y}, {x}) OVER ({SERIES})", f"regr_intercept({y}, {x}) OVER ({SERIES})"


def trimmed_trend(df: DataFrame, value: str = "x", rounds: int = 4) -> DataFrame:
    """Line fit with up to four rounds of dropping far points; null under six points."""
    rows = df.withColumns({"_n": F.expr(f"count(1) OVER ({SERIES})"), "_sel": F.lit(True), "_done": F.lit(False), "trend": F.lit(None).cast("double")})
    for _ in range(rounds):
        slope, start = line_fit(value, "_sel")
        rows = rows.withColumns({"_c": F.expr(f"count_if(_sel) OVER ({SERIES})"), "_b": F.expr(slope), "_a": F.expr(start)})
        rows = rows.withColumn("_run", F.expr("NOT _done AND _c >= 5 AND _n >= 6")).withColumn("trend", F.expr("CASE WHEN _run THEN _a + _b * y ELSE trend END"))
        rows = rows.withColumn("_mad", F.expr(f"median(CASE WHEN _sel THEN abs({value} - trend) END) OVER ({SERIES})"))
        rows = rows.withColumn("_new", F.expr(f"abs({value} - trend) <= greatest(12D, 2.8D * (_mad + 1e-6D))"))
        rows = rows.withColumn("_k", F.expr(f"count_if(_new) OVER ({SERIES})"))
        rows = rows.withColumn("_done", F.expr("_done OR NOT _run OR _k = _c")).withColumn("_sel", F.expr("CASE WHEN _run THEN _new ELSE _sel END"))
    slope, start = line_fit(value, "_sel")
    rows = rows.withColumns({"_c": F.expr(f"count_if(_sel) OVER ({SERIES})"), "_b": F.expr(slope), "_a": F.expr(start)})
    last = F.expr("CASE WHEN trend IS NOT NULL AND _c >= 5 THEN _a + _b * y ELSE trend END")
    return rows.withColumn("trend", last).drop("_n", "_sel", "_done", "_c", "_b", "_a", "_run", "_mad", "_new", "_k")


#: Fixed values of the three corrections: what counts as far, and how far values are pulled.
PULL_TO_GUIDE = "CASE WHEN abs(x - _g) > 24 OR (_top AND x - _g > 16) THEN 0.25D * x + 0.75D * _g ELSE x END"
PULL_TO_LINE = "CASE WHEN abs(_c - _t) > 26 OR (_top AND _c - _t > 18) THEN 0.20D * _c + 0.80D * _t ELSE _c END"
PULL_TO_TREND = (
    "CASE WHEN x - _p > 26 OR abs(x - _g) > 34 OR (_top AND x - _p > 16) THEN 0.18D * x + 0.82D * _p "
    "WHEN _p - x > 34 THEN 0.28D * x + 0.72D * _p ELSE x END"
)
PULL_WEAK = (
    "CASE WHEN _q < 0.18D THEN _p WHEN _q < 0.35D AND abs(x - _p) > 8 THEN 0.10D * x + 0.90D * _p "
    "WHEN _q < 0.52D AND _top AND x - _p > 6 THEN 0.18D * x + 0.82D * _p "
    "WHEN _q < 0.52D AND abs(x - _p) > 11 THEN 0.24D * x + 0.76D * _p ELSE x END"
)
#: Which points are near the upper end, the radius of the wide guide, and the guide, for both guided corrections.
TOP = "idx < greatest(6, cast(rint({0}D * _n) AS int))"
GUIDES = {"stabilise": (4, "0.45D * _m + 0.55D * _w", 0.35), "curve": (5, "0.65D * _m + 0.35D * _w", 0.40)}
ENOUGH_GOOD, TRUSTED = "_k >= greatest(8, cast(rint(0.45D * _n) AS int))", "CASE WHEN _h >= 6 THEN _q >= 0.55D WHEN _l >= 4 THEN _q >= 0.40D ELSE true END"
WEAK_GUIDE, WEAK_TOP = "0.58D * (_a + _b * y) + 0.42D * _m", 0.45


def guided(df: DataFrame, kind: str, order: str) -> DataFrame:
    radius, blend, _ = GUIDES[kind]
    return df.withColumns({"_m": near_median(2, "x", order), "_w": near_median(radius, "x", order)}).withColumn("_g", F.expr(blend)).drop("_m", "_w")


def stabilise(df: DataFrame) -> DataFrame:
    """Blend outliers with a wide guide, then with the trend of the good points."""
    rows = guided(df, "stabilise", ORDER).withColumn("_n", F.expr(f"count(1) OVER ({SERIES})"))
    rows = rows.withColumn("_top", F.expr(TOP.format(GUIDES["stabilise"][2]))).withColumn("_c", F.expr(PULL_TO_GUIDE)).withColumn("_ok", F.expr("abs(_c - _g) <= 18"))
    slope, start = line_fit("_c", "_ok")
    rows = rows.withColumns({"_k": F.expr(f"count_if(_ok) OVER ({SERIES})"), "_b": F.expr(slope), "_a": F.expr(start)})
    rows = rows.withColumn("_t", F.expr(f"CASE WHEN {ENOUGH_GOOD} THEN _a + _b * y END")).withColumn("_c", F.expr(PULL_TO_LINE))
    rows = smoothed(rows, 3, "_s", "_c")
    return rows.withColumn("stable", F.expr("CASE WHEN _n < 5 THEN x ELSE _s END")).drop("_g", "_n", "_top", "_c", "_ok", "_k", "_b", "_a", "_t", "_s")


def consistent_curve(df: DataFrame) -> DataFrame:
    """Pull points that leave the curve back to the trimmed trend of the guide."""
    rows = guided(df, "curve", ORDER).withColumn("_keep", F.expr(f"count(1) OVER ({SERIES})"))
    rows = trimmed_trend(rows, "_g").withColumn("_p", F.coalesce("trend", "_g")).withColumnRenamed("_keep", "_n")
    rows = rows.withColumn("_top", F.expr(TOP.format(GUIDES["curve"][2]))).withColumn("_c", F.expr(PULL_TO_TREND))
    rows = smoothed(rows, 3, "_s", "_c")
    return rows.withColumn("curve", F.expr("CASE WHEN _n < 6 THEN x ELSE _s END")).drop("_g", "_n", "trend", "_p", "_top", "_c", "_s")


def repair_low_confidence(df: DataFrame) -> DataFrame:
    """Blend weak points with the trend of the confident ones and their neighbours."""
    rows = df.withColumn("_q", F.expr("greatest(0D, least(1D, conf))")).withColumn("_m", near_median(2)).withColumns(
        {"_n": F.expr(f"count(1) OVER ({SERIES})"), "_h": F.expr(f"count_if(_q >= 0.55D) OVER ({SERIES})"), "_l": F.expr(f"count_if(_q >= 0.40D) OVER ({SERIES})")}
    )
    rows = rows.withColumn("_use", F.expr(TRUSTED))
    slope, start = line_fit("x", "_use")
    rows = rows.withColumns({"_b": F.expr(slope), "_a": F.expr(start)}).withColumn("_p", F.expr(WEAK_GUIDE))
    rows = rows.withColumn("_top", F.expr(TOP.format(WEAK_TOP))).withColumn("_c", F.expr(PULL_WEAK))
    rows = smoothed(rows, 3, "_s", "_c")
    return rows.withColumn("repaired", F.expr("CASE WHEN _n < 6 THEN x ELSE _s END")).drop("_q", "_m", "_n", "_h", "_l", "_use", "_b", "_a", "_p", "_top", "_c", "_s")


# Edges ------------------------------------------------------------------------------------------


def edge_pick(df: DataFrame, mode: str = "strongest") -> DataFrame:
    """Edge position of a profile: leftmost, rightmost or strongest column; flat gives a flag."""
    pick = {"leftmost": "min(CASE WHEN x >= cut THEN idx END)", "rightmost": "max(CASE WHEN x >= cut THEN idx END)"}.get(
        mode, "max_by(idx, struct(x, -idx))"
    )
    cut = df.withColumn("cut", F.expr(f"greatest(0.35D * max(x) OVER ({SERIES}), percentile(x, 0.75) OVER ({SERIES}))"))
    picked = cut.groupBy("series").agg(
        F.max("x").alias("top"), F.expr(pick).alias("at"), F.expr("max_by(x, struct(x, -idx))").alias("best"), F.max("idx").alias("end")
    )
    flat = "top <= 1e-6D"
    return picked.select(
        "series", F.expr(f"CASE WHEN {flat} THEN end / 2D ELSE cast(at AS double) END").alias("edge"),
        F.expr(f"CASE WHEN {flat} THEN 'sobel_no_edge' ELSE 'sobel_x_{mode}' END").alias("flag"),
    )


def separator_pick(df: DataFrame, wanted: int, separation: float, ratio: float = 0.55) -> DataFrame:
    """Exactly the wanted number of interior maxima, strongest first with spacing, or none."""
    rows = df.withColumns(
        {"n": F.expr(f"count(1) OVER ({SERIES})"), "cut": F.expr(f"greatest({ratio}D * max(x) OVER ({SERIES}), percentile(x, 0.70) OVER ({SERIES}))"),
         "left": F.expr(f"lag(x) OVER ({ORDER})"), "right": F.expr(f"lead(x) OVER ({ORDER})")}
    )
    margin = "greatest(2, cast(rint(0.18D * n) AS int))"
    test = f"n >= 5 AND x >= cut AND x >= left AND x >= right AND idx >= {margin} AND idx < n - {margin} AND cut > 1e-6D"
    found = rows.groupBy("series").agg(F.expr(f"collect_list(CASE WHEN {test} THEN struct(-x AS v, -idx AS o, idx AS idx) END)").alias("c"))
    chosen = found.select("series", F.expr(f"slice({spaced('c', f'{separation}D')}, 1, {wanted})").alias("s"))
    return chosen.select("series", F.expr(f"CASE WHEN size(s) = {wanted} THEN array_sort(s) ELSE cast(array() AS array<bigint>) END").alias("seps"))


def threshold_crossing(df: DataFrame, body: float, dark: float, block: int = BLOCK) -> DataFrame:
    """First idx where the profile falls below the level with a supporting gradient ``neg``."""
    level = body - 0.35 * max(6.0, body - dark)
    ends = df.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    rows = inner(spread(df, 6, 4, block).withColumns(
        {"l": F.expr(f"avg(x) OVER {around(6, -1, BLOCKED)}"), "r": F.expr(f"avg(x) OVER {around(0, 4, BLOCKED)}"), "g": F.expr(f"max(neg) OVER {around(1, 1, BLOCKED)}")}
    ), block)
    hits = rows.filter(F.expr(f"idx >= 4 AND l >= {level + 3.0}D AND r <= {level}D AND g >= 0.06D")).groupBy("series").agg(F.min("idx").alias("crossing"))
    return ends.join(hits, "series", "left").select("series", F.expr("CASE WHEN crossing < n - 6 THEN crossing END").alias("crossing"))


def pull_back(df: DataFrame, body: float, dark: float) -> DataFrame:
    """Move a late candidate to the crossing when the profile around it agrees.

    Rows hold x (array), candidate and crossing.
    """
    part = lambda a, b, default: (
        f"coalesce(get(transform(array(array_sort(slice(x, greatest(0, c + {a}) + 1, greatest(0, least(size(x), c + {b}) - greatest(0, c + {a}))))), "
        f"s -> CASE WHEN size(s) > 0 THEN 0.5D * (get(s, cast((size(s) - 1) div 2 AS int)) + get(s, cast(size(s) div 2 AS int))) END), 0), {default}D)"
    )
    rows = df.withColumn("c", F.col("crossing").cast("int")).withColumns(
        {"_body": F.expr(part(-56, -26, body)), "_left": F.expr(part(-22, -6, body)), "_right": F.expr(part(4, 18, dark)), "_at": F.expr("rint(candidate)")}
    )
    return pulled(rows, body)


def pulled(rows: DataFrame, body: float) -> DataFrame:
    """The rule itself, from medians left and right of the crossing c (`_body`, `_left`, `_right`)."""
    drop_, match = "greatest(0D, _left - _right)", f"greatest(0D, 1D - abs(_body - {body}D) / {max(16.0, 0.25 * body)}D)"
    return rows.withColumn(
        "pulled",
        F.expr(
            f"CASE WHEN c IS NULL OR _at <= c + 6 OR {drop_} < 10 OR {match} < 0.22D THEN candidate "
            "WHEN _at - c > 12 THEN cast(c AS double) ELSE 0.85D * c + 0.15D * candidate END"
        ),
    ).drop("c", "_body", "_left", "_right", "_at")


def progressive_peaks(df: DataFrame, threshold: float, near: int, far: int, start: int = 0) -> DataFrame:
    """Peaks whose minimum spacing grows along the axis; a stronger close one replaces the last."""
    peak = f"x >= {threshold}D AND x >= lag(x) OVER ({ORDER}) AND x > lead(x) OVER ({ORDER}) AND idx >= {start}"
    found = df.withColumn("is_peak", F.expr(peak)).groupBy("series").agg(
        F.expr("array_sort(collect_list(CASE WHEN is_peak THEN struct(idx AS idx, x AS v) END))").alias("c"), F.max("idx").alias("end")
    )
    share = f"least(1D, greatest(0D, (p.idx - {start}) / greatest(1D, cast(end - {start} AS double))))"
    need = f"greatest(1, cast(rint((1D - {share}) * {near} + {share} * {far}) AS int))"
    step = (
        f"CASE WHEN p.idx - element_at(acc, -1).idx >= {need} THEN concat(acc, array(p)) "
        "WHEN p.v > element_at(acc, -1).v THEN concat(slice(acc, 1, size(acc) - 1), array(p)) ELSE acc END"
    )
    fold = f"transform(aggregate(slice(c, 2, greatest(size(c), 1)), slice(c, 1, 1), (acc, p) -> {step}), p -> p.idx)"
    return found.select("series", F.expr(fold).alias("peaks"))


def with_seed(peaks: DataFrame, near: int) -> DataFrame:
    """Puts an early seed in front when it is far enough from the first peak."""
    gap = max(4, round(0.35 * near))
    return peaks.withColumn(
        "peaks",
        F.expr(f"CASE WHEN seed IS NULL THEN peaks WHEN size(peaks) = 0 THEN array(seed) WHEN peaks[0] - seed >= {gap} THEN concat(array(seed), peaks) ELSE peaks END"),
    )


def combine_profiles(strips: DataFrame) -> DataFrame:
    """Strips (series, strip, idx, x in 0..1) to one profile: median and geometric mean."""
    per_idx = strips.withColumn("x", F.expr("greatest(1e-4D, least(1D, x))")).groupBy("series", "idx").agg(
        F.expr("0.45D * median(x) + 0.55D * exp(avg(ln(x)))").alias("x")
    )
    return minmax01(per_idx, "x", "x")
