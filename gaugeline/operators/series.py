"""Profile operators on series of any length, in rows.

Rows are (series, idx, x) with idx from 0 without holes, points are (series, p) with distinct whole p, a run is its points.
Series of up to `most` rows go through the folds and windows of `profiles`, one series at a time; longer ones through the
blocks of `long_series`. Both give the same rows. A period is a table (series, period) with one row per series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.quantiles import exact_median, exact_quantile
from gaugeline.operators import long_series as L
from gaugeline.operators import profiles as P
from gaugeline.operators.long_series import BLOCK
from gaugeline.session import broadcast_if_small, cut_lineage

#: Rows of a table with one row per series that may be broadcast.
FEW_SERIES = 200_000


def with_series(df: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """A table with a row per series put to the rows; broadcast if its counted rows are few."""
    return df.join(broadcast_if_small(table, FEW_SERIES), "series", how)


def packed(points: DataFrame, name: str = "peaks") -> DataFrame:
    return points.groupBy("series").agg(F.array_sort(F.collect_list("p")).alias(name))


def unpacked(df: DataFrame, column: str) -> DataFrame:
    return df.select("series", F.explode(column).alias("p"))


def both(df: DataFrame, most: int, short, long) -> DataFrame:
    few, many = L.split_by_length(df, most)
    return short(few) if many is None else short(few).unionByName(long(many))


# Peaks ----------------------------------------------------------------------------------------------


def local_peaks(df: DataFrame, threshold: float, min_distance: int, most: int = BLOCK) -> DataFrame:
    """Points of the peaks, strongest first with a minimum spacing."""

    def long(rows: DataFrame) -> DataFrame:
        near = Window.partitionBy("series", "_block").orderBy("idx")
        seen = L.spread(rows, 1, 1, most).select("series", "idx", "x", "_block", F.lag("x").over(near).alias("l"), F.lead("x").over(near).alias("r"))
        peaks = L.inner(seen, most).where((F.col("x") >= threshold) & (F.col("x") >= F.col("l")) & (F.col("x") > F.col("r")))
        return L.spaced(peaks, max(1, min_distance), block=most).select("series", F.col("idx").alias("p"))

    return both(df, most, lambda rows: unpacked(P.local_peaks(rows, threshold, min_distance), "peaks"), long)


def separator_pick(df: DataFrame, wanted: int, separation: float, ratio: float = 0.55, most: int = BLOCK) -> DataFrame:
    """Exactly the wanted number of interior maxima, strongest first with spacing, or none."""

    def long(rows: DataFrame) -> DataFrame:
        near = Window.partitionBy("series", "_block").orderBy("idx")
        cuts = exact_quantile(rows, ["series"], 0.70, "high", "x").join(rows.groupBy("series").agg(F.max("x").alias("top")), "series")
        cuts = cuts.select("series", F.col("total").alias("n"), F.greatest(F.lit(ratio) * F.col("top"), "high").alias("cut"))
        seen = L.inner(L.spread(rows, 1, 1, most).withColumns({"l": F.lag("x").over(near), "r": F.lead("x").over(near)}), most)
        margin = "greatest(2, cast(rint(0.18D * n) AS int))"
        test = f"n >= 5 AND x >= cut AND x >= l AND x >= r AND idx >= {margin} AND idx < n - {margin} AND cut > 1e-6D"
        kept = L.spaced(with_series(seen, cuts).where(test), int(np.ceil(separation)), late=True, block=most)
        best = kept.withColumn("k", F.row_number().over(Window.partitionBy("series").orderBy(F.col("x").desc(), F.col("idx").desc()))).where(F.col("k") <= wanted)
        full = best.groupBy("series").agg(F.array_sort(F.collect_list("idx")).alias("seps")).where(F.size("seps") == wanted)
        return unpacked(full, "seps")

    return both(df, most, lambda rows: unpacked(P.separator_pick(rows, wanted, separation, ratio), "seps"), long)


def progressive_peaks(df: DataFrame, threshold: float, near: int, far: int, start: int = 0, most: int = BLOCK) -> DataFrame:
    """Peaks whose minimum spacing grows along the axis; a stronger close one replaces the last."""

    def long(rows: DataFrame) -> DataFrame:
        around = Window.partitionBy("series", "_block").orderBy("idx")
        seen = L.inner(L.spread(rows, 1, 1, most).withColumns({"l": F.lag("x").over(around), "r": F.lead("x").over(around)}), most)
        test = (F.col("x") >= threshold) & (F.col("x") >= F.col("l")) & (F.col("x") > F.col("r")) & (F.col("idx") >= start)
        ends = rows.groupBy("series").agg(F.max("idx").alias("end"))
        share = f"least(1D, greatest(0D, (p - {start}) / greatest(1D, cast(end - {start} AS double))))"
        need = F.expr(f"greatest(1, cast(rint((1D - {share}) * {near} + {share} * {far}) AS int))")
        points = with_series(seen.where(test).select("series", F.col("idx").alias("p"), "x"), ends).select("series", "p", "x", need.alias("need"))
        points = cut_lineage(L.numbered(points, most))

        def rule(part: pd.DataFrame) -> np.ndarray:
            p, x, need_ = (part[c].to_numpy() for c in ("p", "x", "need"))
            out = np.full(len(p), -1, np.int64)
            for i in range(len(p)):
                for j in range(i + 1, min(len(p), i + 1 + max(near, far))):
                    if p[j] - p[i] >= need_[j] or x[j] > x[i]:
                        out[i] = j
                        break
            return out

        nodes = L.linked(points, rule, max(near, far), most)
        walk = L.walked(nodes, points.where("pos = 0"), most)
        after = points.select("series", F.col("pos").alias("next"), F.col("p").alias("next_p"), F.col("need").alias("next_need"))
        told = walk.join(nodes.select("series", "pos", "next"), ["series", "pos"]).join(points.select("series", "pos", "p"), ["series", "pos"]).join(after, ["series", "next"], "left")
        return told.where("next IS NULL OR next_p - p >= next_need").select("series", "p")

    return both(df, most, lambda rows: unpacked(P.progressive_peaks(rows, threshold, near, far, start), "peaks"), long)


# Points and periods ---------------------------------------------------------------------------------


def bounded_median_gap(points: DataFrame, low: float = 12.0, high: float = 40.0, most: int = BLOCK) -> DataFrame:
    """Median of the gaps between neighbours that lie in a band: (series, gap); null with fewer than three points or no such gap."""

    def long(rows: DataFrame) -> DataFrame:
        steps = steps_of(L.numbered(rows, most), most)
        return rows.select("series").distinct().join(
            exact_median(steps.where(F.col("v").between(low, high)), ["series"], "gap").drop("total"), "series", "left"
        )

    return both(points, most, lambda rows: packed(rows).select("series", P.bounded_median_gap("peaks", low, high).alias("gap")), long)


def steps_of(points: DataFrame, most: int) -> DataFrame:
    """Numbered points with `v`, the distance from the point before (null for the first)."""
    order = Window.partitionBy("series", "_block").orderBy("pos")
    return L.inner(L.spread(points, 1, 0, most, "pos").withColumn("v", (F.col("p") - F.lag("p").over(order)).cast("double")), most, "pos")


def thin(points: DataFrame, separation: DataFrame, most: int = BLOCK) -> DataFrame:
    """Drops points closer than `sep` (a table by series) to the last kept one; for long series."""
    numbers = cut_lineage(L.numbered(with_series(points.select("series", "p").distinct(), separation), most))
    ahead = numbers.agg(F.coalesce(F.max("sep"), F.lit(1))).first()[0]

    def rule(part: pd.DataFrame) -> np.ndarray:
        p = part["p"].to_numpy()
        at = np.searchsorted(p, p + part["sep"].to_numpy())
        return np.where(at < len(p), at, -1)

    kept = L.walked(L.linked(numbers, rule, int(ahead), most), numbers.where("pos = 0"), most)
    return numbers.join(kept, ["series", "pos"], "left_semi").select("series", "p")


def separation_of(periods: DataFrame) -> DataFrame:
    return periods.select("series", F.expr(P.SEPARATION).alias("sep"))


def fill_missing(points: DataFrame, periods: DataFrame, most: int = BLOCK) -> DataFrame:
    """Fills gaps above 1.65 periods evenly, then drops points that are too close."""

    def long(rows: DataFrame) -> DataFrame:
        usable = periods.where("period >= 8D")
        steps = with_series(steps_of(cut_lineage(L.numbered(rows, most)), most), usable, "left").withColumn("last", F.col("p") - F.col("v"))
        missing = "(cast(rint(v / period) AS int) - 1)"
        new = (
            f"if(v > 1.65D * period AND {missing} > 0, transform(sequence(1, greatest(1, {missing})), "
            f"j -> cast(rint(last + v / greatest(1D, {missing} + 1D) * j) AS bigint)), cast(array() AS array<bigint>))"
        )
        filled = steps.select("series", "period", F.explode(F.concat(F.coalesce(F.expr(new), F.array().cast("array<bigint>")), F.array("p"))).alias("p"))
        thinned = thin(filled.where("period IS NOT NULL"), separation_of(usable), most)
        return thinned.unionByName(filled.where("period IS NULL").select("series", "p"))

    short = lambda rows: unpacked(P.fill_missing(packed(rows).join(periods, "series")), "peaks")
    return both(points, most, short, long)


def best_periodic_run(points: DataFrame, low: int = 14, high: int = 34, min_len: int = 6, most: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Points of the longest run with regular gaps (the earliest on ties; all points if none is long enough), and (series, run_period)."""
    few, many = L.split_by_length(points, most)
    folded = P.best_periodic_run(packed(few), low, high, min_len)
    runs, periods = unpacked(folded, "run"), folded.select("series", "run_period")
    if many is None:
        return runs, periods
    numbers = cut_lineage(L.numbered(many, most))

    def rule(part: pd.DataFrame) -> np.ndarray:
        p = part["p"].to_numpy()
        at = np.searchsorted(p, p + low)
        fits = at < len(p)
        fits[fits] = p[at[fits]] - p[fits] <= high
        return np.where(fits, at, -1)

    nodes = L.linked(numbers, rule, high + 1, most)
    lengths = L.walk_lengths(nodes).where(F.col("n") >= min_len)
    start = cut_lineage(lengths.groupBy("series").agg(F.max_by("pos", F.struct("n", -F.col("pos"))).alias("pos")))
    regular = numbers.join(L.walked(nodes, start, most), ["series", "pos"], "left_semi").select("series", "p")
    others = many.join(start, "series", "left_anti").select("series", "p")
    regular = cut_lineage(regular)
    gaps = bounded_median_gap(regular, float(low), float(high), most).unionByName(bounded_median_gap(others, most=most))
    return runs.unionByName(regular.unionByName(others)), periods.unionByName(gaps.withColumnRenamed("gap", "run_period"))


def bottom_cluster(points: DataFrame, periods: DataFrame, height: int, min_peaks: int = 8, most: int = BLOCK) -> DataFrame:
    """Points from the start of the longest regular run in the lower part on; else all of them."""

    def long(rows: DataFrame) -> DataFrame:
        numbers = cut_lineage(L.numbered(rows, most))
        middle = exact_median(steps_of(numbers, most), ["series"], "step").drop("total")
        bands = middle.join(periods, "series", "left").select("series", F.coalesce("period", "step").alias("_p")).select(
            "series", F.expr("greatest(12, cast(floor(0.75D * _p) AS int))").alias("lo"), F.expr("cast(ceil(1.15D * _p) AS int)").alias("hi")
        )
        ruled = cut_lineage(with_series(numbers, bands))

        def rule(part: pd.DataFrame) -> np.ndarray:
            p, low, high = part["p"].to_numpy(), part["lo"].to_numpy(), np.maximum(part["lo"] + 1, part["hi"]).to_numpy()
            step = np.diff(p, append=p[-1])
            fits = (step >= low) & (step <= high)
            fits[-1] = False
            return np.where(fits, np.arange(1, len(p) + 1), -1)

        nodes = L.linked(ruled, rule, 1, most)
        inside = nodes.where("next IS NOT NULL").select("series", F.col("next").alias("pos"))
        begins = L.walk_lengths(nodes).join(inside, ["series", "pos"], "left_anti").join(numbers.select("series", "pos", "p"), ["series", "pos"])
        floor_y = round(0.45 * height)
        best = begins.where((F.col("n") >= max(2, min_peaks)) & (F.col("p") >= floor_y)).groupBy("series").agg(F.max_by("pos", F.struct("n", "p")).alias("first"))
        return with_series(numbers, best, "left").where("first IS NULL OR pos >= first").select("series", "p")

    short = lambda rows: unpacked(P.bottom_cluster(packed(rows).join(periods, "series", "left"), height, min_peaks), "cluster")
    return both(points, most, short, long)


def _by_length_of(profile: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    sizes = cut_lineage(profile.groupBy("series").agg(F.count(F.lit(1)).alias("size")))
    return sizes.where(F.col("size") <= most), sizes.where(F.col("size") > most)


def extend_periodic(run: DataFrame, points: DataFrame, periods: DataFrame, profile: DataFrame, y_min: int = 0, y_max: int | None = None, most: int = BLOCK) -> DataFrame:
    """Extends a run up and down by one period at a time, see `profiles.extend_periodic`.

    `profile` has (series, idx, x) with x in 0..1 and tells the length of a series.
    """
    few, many = _by_length_of(profile, most)
    only = lambda df, sizes: df.join(sizes.select("series"), "series", "left_semi")
    arrays = P.as_arrays(only(profile, few), "x").join(packed(run, "run"), "series", "left").join(packed(points), "series", "left").join(periods, "series", "left")
    empty = F.array().cast("array<bigint>")
    short = unpacked(P.extend_periodic(arrays.withColumns({"run": F.coalesce("run", empty), "peaks": F.coalesce("peaks", empty)}), y_min, y_max), "extended")
    if many.isEmpty():
        return short
    values = only(profile, many)
    level = exact_quantile(values, ["series"], 0.55, "level", "x").select("series", F.greatest(F.lit(0.16), "level").alias("support"))
    facts = cut_lineage(
        many.join(periods.where("period >= 8D"), "series").join(level, "series")
        .withColumns({"sep": F.expr(P.SEPARATION), "snap": F.expr("greatest(5, cast(rint(0.40D * period) AS int))")})
    )
    marked = values.join(points.select("series", F.col("p").alias("idx"), F.lit(True).alias("peak")), ["series", "idx"], "left")
    marked = with_series(marked, facts).withColumn("peak", F.coalesce("peak", F.lit(False)))
    reach = int(np.ceil(facts.agg(F.coalesce(F.max(F.col("period") + F.col("snap")), F.lit(1.0))).first()[0])) + 2
    ends = run.join(facts.select("series", "size"), "series").groupBy("series", "size").agg(F.min("p").alias("top"), F.max("p").alias("low"))
    found = []
    for sign, edge in ((-1, "top"), (1, "low")):
        # places are counted in the direction of the walk
        place = F.col("idx") if sign > 0 else F.col("size") - 1 - F.col("idx")
        begin = F.col(edge) if sign > 0 else F.col("size") - 1 - F.col(edge)

        def rule(part: pd.DataFrame, sign: int = sign) -> np.ndarray:
            idx, x, first = part["idx"].to_numpy(), part["x"].to_numpy(), part.iloc[0]
            period, sep, snap, support, size = (first[c] for c in ("period", "sep", "snap", "support", "size"))
            guess = np.rint(idx + sign * period).astype(np.int64)
            top = size - 1 if y_max is None else min(size - 1, y_max)
            allowed = guess >= y_min if sign < 0 else guess <= top
            # the nearest peak, the smaller one on ties
            peaks = np.sort(idx[part["peak"].to_numpy(bool)])
            padded = np.concatenate([[-(1 << 60)], peaks, [1 << 60]])
            at = np.searchsorted(padded, guess)
            right, left = padded[at], padded[at - 1]
            near = np.where(guess - left <= right - guess, left, right)
            here = (guess - idx[0]) * sign  # where the guess stands in this list
            inside = (here >= 0) & (here < len(idx))
            strong = np.zeros(len(idx), bool)
            strong[inside] = x[here[inside]] >= support
            to = np.where(np.abs(near - guess) <= snap, near, np.where(strong & (guess >= 0) & (guess < size), guess, -1))
            fits = allowed & (to >= 0) & (sign * (to - idx) >= sep)
            where = (to - idx[0]) * sign
            return np.where(fits & (where >= 0) & (where < len(idx)), where, -1)

        nodes = L.linked(marked.withColumn("pos", place.cast("long")), rule, reach, most)
        walk = L.walked(nodes, ends.select("series", begin.cast("long").alias("pos")), most)
        found.append(with_series(walk, many).select("series", (F.col("pos") if sign > 0 else F.col("size") - 1 - F.col("pos")).alias("p")))
    stretched = run.select("series", "p").join(facts.select("series"), "series", "left_semi").unionByName(found[0]).unionByName(found[1])
    plain = only(run.select("series", "p"), many).join(facts.select("series"), "series", "left_anti")
    return short.unionByName(thin(stretched, facts.select("series", "sep"), most)).unionByName(plain)


def extend_supported(run: DataFrame, periods: DataFrame, profile: DataFrame, support: float, most: int = BLOCK) -> DataFrame:
    """Up to four more points above a run and two below while the band around them is supported.

    Only the values that these points can see are packed, so the length of a series does not matter.
    """
    few, many = _by_length_of(profile, most)
    only = lambda df, sizes: df.join(sizes.select("series"), "series", "left_semi")
    empty = F.array().cast("array<bigint>")
    arrays = P.as_arrays(only(profile, few), "x").join(packed(run, "run"), "series", "left").join(periods, "series", "left")
    short = unpacked(P.extend_supported(arrays.withColumn("run", F.coalesce("run", empty)), support), "extended")
    if many.isEmpty():
        return short
    held = only(run.select("series", "p"), many)
    out = short.unionByName(held)
    for first, steps in ((True, 4), (False, 2)):
        edge = held.groupBy("series").agg((F.min("p") if first else F.max("p")).alias("edge")).join(periods.where("period > 0D"), "series")
        width = F.ceil((steps + 1) * F.col("period")) + 4
        seen = with_series(only(profile, many), edge.withColumn("width", width))
        # the packed values begin at an even place, so that halves round as they do in the whole series
        seen = seen.where((F.col("idx") >= 2 * F.floor((F.col("edge") - F.col("width")) / 2)) & (F.col("idx") <= F.col("edge") + F.col("width")))
        part = P.as_arrays(seen.select("series", "idx", "x"), "x", "idx").join(edge, "series").withColumn("off", F.get("idx", F.lit(0))).withColumn("run", F.array(F.col("edge") - F.col("off")))
        more = P.extend_supported(part, support).select("series", "edge", "off", F.explode("extended").alias("q")).select("series", "edge", (F.col("q") + F.col("off")).alias("p"))
        out = out.unionByName(more.where(F.col("p") < F.col("edge") if first else F.col("p") > F.col("edge")).select("series", "p"))
    return out


# Periods, trends and corrections --------------------------------------------------------------------

#: Pairs of blocks whose products one task sums.
PAIRS = 32


def dominant_period(df: DataFrame, low: float = 0.02, high: float = 0.50, most: int = BLOCK) -> DataFrame:
    """Lag of the largest autocorrelation within a share of the length; null under 8 points."""

    def long(rows: DataFrame) -> DataFrame:
        kind = rows.schema["series"].dataType.simpleString()
        facts = rows.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), ((F.var_pop("x") * F.count(F.lit(1))) + 1e-9).alias("power"))
        facts = facts.withColumn("lo", F.expr(f"greatest(4, cast(rint({low}D * n) AS int))")).withColumn("hi", F.expr(f"least(n, greatest(lo + 1, cast(rint({high}D * n) AS int)))"))
        facts = cut_lineage(facts)
        centred = with_series(rows, facts).select("series", "idx", (F.col("x") - F.col("mean")).alias("x"), F.floor(F.col("idx") / F.lit(most)).alias("b"))
        blocks = centred.groupBy("series", "b").agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("v"))
        # block i meets block i + d for every distance d that a wanted lag can span
        reach = F.sequence(F.lit(0), F.floor((F.col("hi") + most - 2) / F.lit(most)))
        meet = with_series(blocks, facts.select("series", "hi")).withColumn("d", F.explode(reach))
        left = meet.select("series", "d", F.col("b").alias("i"), F.transform("v", lambda e: e["x"]).alias("a"))
        right = meet.where("b >= d").select("series", "d", (F.col("b") - F.col("d")).alias("i"), F.transform("v", lambda e: e["x"]).alias("c"))
        pairs = left.join(right, ["series", "d", "i"]).withColumn("part", F.floor(F.col("i") / F.lit(PAIRS)))

        def products(part: pd.DataFrame) -> pd.DataFrame:
            size, total = 2 * most, np.zeros(2 * most)
            for a, c in zip(part["a"], part["c"]):
                total += np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(c, size), size)
            lag = np.arange(-most + 1, most)
            return pd.DataFrame({"series": part["series"].iloc[0], "k": part["d"].iloc[0] * most + lag, "r": total[lag]})

        sums = pairs.groupBy("series", "d", "part").applyInPandas(products, f"series {kind}, k long, r double")
        strong = sums.groupBy("series", "k").agg(F.sum("r").alias("r"))
        best = with_series(strong, facts).where("k >= lo AND k < hi").groupBy("series").agg(F.max(F.struct((F.col("r") / F.col("power")).alias("r"), (-F.col("k")).alias("k"))).alias("best"))
        return best.select("series", (-F.col("best.k")).cast("double").alias("period"), F.col("best.r").alias("strength"))

    return both(df, most, lambda rows: P.dominant_period(rows, low, high), long)


def _trend_lines(rows: DataFrame, rounds: int) -> DataFrame:
    """(series, a, b): the trimmed trend's line from rows (series, y, v); null where there is none."""
    key = ["series"]
    state = cut_lineage(rows.groupBy("series").agg(F.count(F.lit(1)).alias("n")).select(
        "series", "n", *[F.lit(None).cast("double").alias(c) for c in ("a", "b", "sa", "sb", "limit")], F.lit(False).alias("done")
    ))
    fit = [F.regr_slope("v", "y").alias("fb"), F.regr_intercept("v", "y").alias("fa"), F.count(F.lit(1)).alias("c")]
    for _ in range(rounds):
        # the chosen points are those near the line of the round before, so rows are never written again
        chosen = with_series(rows, state.select("series", "sa", "sb", "limit")).where("limit IS NULL OR abs(v - (sa + sb * y)) <= limit")
        fitted = state.join(chosen.groupBy("series").agg(*fit), key, "left").withColumn("go", F.expr("NOT done AND c >= 5 AND n >= 6"))
        fitted = cut_lineage(fitted.withColumns({"a": F.expr("CASE WHEN go THEN fa ELSE a END"), "b": F.expr("CASE WHEN go THEN fb ELSE b END")}))
        if fitted.where("go").isEmpty():
            state = fitted.drop("fb", "fa", "c", "go")
            break
        apart = with_series(chosen.select("series", "y", "v"), fitted.where("go").select("series", "a", "b")).select("series", F.abs(F.col("v") - (F.col("a") + F.col("b") * F.col("y"))).alias("v"))
        limits = fitted.join(exact_median(apart, key, "mad").drop("total"), key, "left").withColumn("new", F.expr("greatest(12D, 2.8D * (mad + 1e-6D))"))
        limits = cut_lineage(limits)
        near = with_series(rows, limits.where("go").select("series", "a", "b", "new")).groupBy("series").agg(F.count_if(F.abs(F.col("v") - (F.col("a") + F.col("b") * F.col("y"))) <= F.col("new")).alias("k"))
        state = cut_lineage(limits.join(near, key, "left").select(
            "series", "n", "a", "b", F.expr("CASE WHEN go THEN a ELSE sa END").alias("sa"), F.expr("CASE WHEN go THEN b ELSE sb END").alias("sb"),
            F.expr("CASE WHEN go THEN new ELSE limit END").alias("limit"), F.expr("done OR NOT go OR coalesce(k = c, false)").alias("done"),
        ))
    chosen = with_series(rows, state.select("series", "sa", "sb", "limit")).where("limit IS NULL OR abs(v - (sa + sb * y)) <= limit")
    last = state.join(chosen.groupBy("series").agg(*fit), key, "left")
    better = "a IS NOT NULL AND c >= 5"
    return last.select("series", F.expr(f"CASE WHEN {better} THEN fa ELSE a END").alias("a"), F.expr(f"CASE WHEN {better} THEN fb ELSE b END").alias("b"))


def trimmed_trend(df: DataFrame, value: str = "x", rounds: int = 4, most: int = BLOCK) -> DataFrame:
    """Adds `trend`: a line with up to four rounds of dropping far points; null under six points."""

    def long(rows: DataFrame) -> DataFrame:
        lines = _trend_lines(rows.select("series", "y", F.col(value).alias("v")), rounds)
        return with_series(rows, lines.select("series", F.col("a").alias("_a"), F.col("b").alias("_b"))).withColumn("trend", F.expr("_a + _b * y")).drop("_a", "_b")

    return both(df, most, lambda rows: P.trimmed_trend(rows, value, rounds), long)


def _finished(rows: DataFrame, name: str, fewest: int, columns: list[str], most: int) -> DataFrame:
    """Smooths the corrected `_c` inside blocks, drops the borders."""
    done = P.smoothed(rows, 3, "_s", "_c", P.BLOCKED).withColumn(name, F.expr(f"CASE WHEN _n < {fewest} THEN x ELSE _s END"))
    return L.inner(done, most).select(*columns, name)


def _own(rows: DataFrame, most: int) -> DataFrame:
    return rows.where(F.floor(F.col("idx") / F.lit(most)) == F.col("_block"))


def stabilise(df: DataFrame, most: int = BLOCK) -> DataFrame:
    """Blend outliers with a wide guide, then with the trend of the good points."""

    def long(rows: DataFrame) -> DataFrame:
        reach = P.GUIDES["stabilise"][0] + 1
        sizes = rows.groupBy("series").agg(F.count(F.lit(1)).alias("_n"))
        seen = with_series(P.guided(L.spread(rows, reach, reach, most), "stabilise", P.BLOCKED), sizes)
        seen = seen.withColumn("_top", F.expr(P.TOP.format(P.GUIDES["stabilise"][2]))).withColumn("_c", F.expr(P.PULL_TO_GUIDE))
        good = _own(seen, most).where("abs(_c - _g) <= 18").groupBy("series").agg(F.count(F.lit(1)).alias("_k"), F.regr_slope("_c", "y").alias("_b"), F.regr_intercept("_c", "y").alias("_a"))
        fitted = with_series(seen, good, "left").withColumn("_t", F.expr(f"CASE WHEN {P.ENOUGH_GOOD} THEN _a + _b * y END")).withColumn("_c", F.expr(P.PULL_TO_LINE))
        return _finished(fitted, "stable", 5, df.columns, most)

    return both(df, most, P.stabilise, long)


def consistent_curve(df: DataFrame, most: int = BLOCK) -> DataFrame:
    """Pull points that leave the curve back to the trimmed trend of the guide."""

    def long(rows: DataFrame) -> DataFrame:
        reach = P.GUIDES["curve"][0] + 1
        sizes = rows.groupBy("series").agg(F.count(F.lit(1)).alias("_n"))
        seen = cut_lineage(with_series(P.guided(L.spread(rows, reach, reach, most), "curve", P.BLOCKED), sizes))
        lines = _trend_lines(_own(seen, most).select("series", "y", F.col("_g").alias("v")), 4).select("series", F.col("a").alias("_a"), F.col("b").alias("_b"))
        bent = with_series(seen, lines).withColumn("_p", F.expr("coalesce(_a + _b * y, _g)")).withColumn("_top", F.expr(P.TOP.format(P.GUIDES["curve"][2])))
        return _finished(bent.withColumn("_c", F.expr(P.PULL_TO_TREND)), "curve", 6, df.columns, most)

    return both(df, most, P.consistent_curve, long)


def repair_low_confidence(df: DataFrame, most: int = BLOCK) -> DataFrame:
    """Blend weak points with the trend of the confident ones and their neighbours."""

    def long(rows: DataFrame) -> DataFrame:
        rated = rows.withColumn("_q", F.expr("greatest(0D, least(1D, conf))"))
        sizes = rated.groupBy("series").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_q") >= 0.55).alias("_h"), F.count_if(F.col("_q") >= 0.40).alias("_l"))
        seen = with_series(L.spread(rated, 3, 3, most).withColumn("_m", P.near_median(2, "x", P.BLOCKED)), sizes)
        used = _own(seen, most).where(F.expr(P.TRUSTED)).groupBy("series").agg(F.regr_slope("x", "y").alias("_b"), F.regr_intercept("x", "y").alias("_a"))
        fitted = with_series(seen, used, "left").withColumn("_p", F.expr(P.WEAK_GUIDE)).withColumn("_top", F.expr(P.TOP.format(P.WEAK_TOP)))
        return _finished(fitted.withColumn("_c", F.expr(P.PULL_WEAK)), "repaired", 6, df.columns, most)

    return both(df, most, P.repair_low_confidence, long)


def pull_back(df: DataFrame, crossing: DataFrame, candidate: DataFrame, body: float, dark: float) -> DataFrame:
    """Moves late candidates to the crossing when the profile around it agrees: (series, crossing, candidate, pulled).

    Only the rows around the crossing are gathered, at most 74 per series.
    """
    at = crossing.join(candidate, "series")
    close = with_series(df.select("series", "idx", "x"), crossing.where("crossing IS NOT NULL")).where((F.col("idx") >= F.col("crossing") - 56) & (F.col("idx") < F.col("crossing") + 18))
    part = lambda a, b: F.median(F.when((F.col("idx") >= F.col("crossing") + a) & (F.col("idx") < F.col("crossing") + b), F.col("x")))
    medians = close.groupBy("series").agg(part(-56, -26).alias("_body"), part(-22, -6).alias("_left"), part(4, 18).alias("_right"))
    rows = at.join(medians, "series", "left").withColumns({
        "c": F.col("crossing").cast("int"), "_at": F.expr("rint(candidate)"), "_body": F.coalesce("_body", F.lit(float(body))),
        "_left": F.coalesce("_left", F.lit(float(body))), "_right": F.coalesce("_right", F.lit(float(dark))),
    })
    return P.pulled(rows, body)
