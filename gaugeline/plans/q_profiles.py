"""Queries on one-dimensional profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import profiles as R
from gaugeline.operators import series as S_
from gaugeline.plans import views
from gaugeline.plans.registry import mid, query, r6
from gaugeline.plans.views import NEEDS, VIEWS, sql
from gaugeline.session import cut_lineage

VIEWS["v_line"] = "SELECT series, idx, value AS x, idx * 8.0::DOUBLE AS y, (idx * 37 % 100) / 100.0::DOUBLE AS conf FROM v_profile"
NEEDS["v_line"] = ["v_profile"]
W = "WINDOW w AS (PARTITION BY series ORDER BY idx)"
S = "PARTITION BY series"


def line(spark, sf):
    """Profile rows with a stack position y and a confidence."""
    return views.profiles(spark, sf).select(
        "series", "idx", F.col("value").alias("x"), F.expr("idx * 8D").alias("y"), F.expr("(idx * 37 % 100) / 100D").alias("conf")
    )


def shown(df, *values):
    return df.select("series", "idx", *[r6(v).alias(v) for v in values])


@query("d7_moving_average", sql("v_line", f"""
SELECT series, idx, round(sum(x) OVER (w ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9.0::DOUBLE, 6) AS smooth FROM v_line {W}"""))
def moving_average(spark, sf):
    return shown(R.moving_average(line(spark, sf), 8), "smooth")


@query("d8_normalise", sql("v_line", f"""
SELECT series, idx, round((x - min(x) OVER s) / ((max(x) OVER s - min(x) OVER s) + 1e-6), 6) AS unit, round(x / (max(x) OVER s + 1e-6), 6) AS scaled
FROM v_line WINDOW s AS ({S})"""))
def normalise(spark, sf):
    return shown(R.max_norm(R.minmax01(line(spark, sf))), "unit", "scaled")


PEAK = "x >= {0} AND x >= lag(x) OVER w AND x > lead(x) OVER w"


def spaced(test, distance):
    return f"""(SELECT series, list_reduce(list_transform(c, lambda v: [v]), lambda acc, b:
       CASE WHEN len(list_filter(acc, lambda k: abs(k - b[1]) < {distance})) > 0 THEN acc ELSE list_concat(acc, b) END) AS kept
     FROM (SELECT series, list(idx ORDER BY x DESC, idx) AS c FROM (SELECT *, {test} AS p FROM v_line {W}) WHERE p GROUP BY 1))"""


@query("d9_local_peaks", sql("v_line", f"""
SELECT series, unnest(kept) AS peak FROM {spaced(PEAK.format('5.0'), 3)}"""))
def local_peaks(spark, sf):
    return S_.local_peaks(line(spark, sf), 5.0, 3).select("series", F.col("p").alias("peak"))


@query("d10_rolling_median", sql("v_line", f"""
SELECT series, idx, round({mid('a')}, 6) AS median, round(list_sort([coalesce(p2, f), coalesce(p1, f), x, coalesce(n1, l), coalesce(n2, l)])[3], 6) AS edge FROM (
  SELECT series, idx, x, list_sort(list(x) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS a, lag(x, 2) OVER w AS p2, lag(x) OVER w AS p1,
         lead(x) OVER w AS n1, lead(x, 2) OVER w AS n2, first_value(x) OVER w AS f, last_value(x) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l
  FROM v_line {W})"""))
def rolling_median(spark, sf):
    return shown(R.edge_median(R.rolling_median(line(spark, sf), 2), 5, "edge"), "median", "edge")


VIEWS["v_ranges"] = f"""
  SELECT series, min(idx) AS s, max(idx) AS e FROM (SELECT *, idx - row_number() OVER w AS g FROM (SELECT * FROM v_line WHERE x >= 5.0) {W})
  GROUP BY series, g HAVING max(idx) - min(idx) + 1 >= 2"""
NEEDS["v_ranges"] = ["v_line"]


@query("d11_true_ranges", sql("v_ranges", f"""
WITH m AS (SELECT *, CASE WHEN s - max(e) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 3 THEN 0 ELSE 1 END AS o FROM v_ranges WINDOW w AS ({S} ORDER BY s)),
g AS (SELECT *, sum(o) OVER ({S} ORDER BY s) AS k FROM m), j AS (SELECT series, min(s) AS s, max(e) AS e FROM g GROUP BY series, k),
f AS (SELECT series, min(s) AS first, max(e) AS last FROM v_ranges GROUP BY 1),
sc AS (SELECT j.series, s, e, (e - s + 1) * {mid('list_sort(list(x))')} AS score FROM j JOIN v_line l ON l.series = j.series AND l.idx BETWEEN s AND e GROUP BY 1, 2, 3)
SELECT series, s AS start, e AS "end", round(score, 6) AS score, first, last FROM (SELECT *, row_number() OVER ({S} ORDER BY score DESC, s) AS k FROM sc) JOIN f USING (series) WHERE k = 1"""))
def true_ranges(spark, sf):
    rows = line(spark, sf)
    ranges = R.true_ranges(rows, "x >= 5.0", 2)
    best = R.best_range(R.merge_ranges(ranges, 3), rows).withColumn("score", r6("score"))
    return best.join(R.full_range(ranges).select("series", F.col("start").alias("first"), F.col("end").alias("last")), "series")


@query("d12_dominant_period", sql("v_line", """
WITH c AS (SELECT series, count(*) AS n, avg(x) AS m FROM v_line GROUP BY 1),
z AS (SELECT series, idx, n, x - m AS x FROM v_line JOIN c USING (series)),
b AS (SELECT series, n, greatest(4, CAST(round_even(0.05 * n, 0) AS INTEGER)) AS lo FROM c WHERE n >= 8),
h AS (SELECT *, greatest(lo + 1, CAST(round_even(0.5 * n, 0) AS INTEGER)) AS hi FROM b),
a AS (SELECT p.series, q.idx - p.idx AS k, sum(p.x * q.x) AS r FROM z p JOIN z q ON q.series = p.series AND q.idx > p.idx GROUP BY 1, 2),
t AS (SELECT a.series, k, r / (pw + 1e-9) AS r FROM a JOIN h ON h.series = a.series AND k >= lo AND k < hi
      JOIN (SELECT series, sum(x * x) AS pw FROM z GROUP BY 1) e ON e.series = a.series)
SELECT c.series, CAST(k AS DOUBLE) AS period, round(r, 6) AS strength FROM c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY series ORDER BY r DESC, k) AS o FROM t) t
ON t.series = c.series AND o = 1"""))
def dominant_period(spark, sf):
    return S_.dominant_period(line(spark, sf), 0.05, 0.5).select("series", "period", r6("strength").alias("strength"))


def peak_points(spark, sf):
    """Peaks in pixels (eight per step)."""
    return S_.local_peaks(line(spark, sf), 5.0, 2).select("series", (F.col("p") * 8).alias("p"))


def periods(spark, sf, points):
    """A period for every series, 22 where its peaks tell none."""
    gaps = S_.bounded_median_gap(points)
    return line(spark, sf).select("series").distinct().join(gaps, "series", "left").select("series", F.coalesce("gap", F.lit(22.0)).alias("period"))


VIEWS["v_peaks"] = f"""
  SELECT series, list_transform(list_sort(kept), lambda p: p * 8) AS peaks FROM {spaced(PEAK.format('5.0'), 2)}"""
NEEDS["v_peaks"] = ["v_line"]
GAPS = "list_sort(list_filter(list_transform(range(1, len(peaks)), lambda i: CAST(peaks[i + 1] - peaks[i] AS DOUBLE)), lambda g: g BETWEEN 12 AND 40))"
VIEWS["v_period"] = f"SELECT *, CASE WHEN len(peaks) >= 3 THEN {mid('g')} END AS gap FROM (SELECT *, {GAPS} AS g FROM v_peaks)"
NEEDS["v_period"] = ["v_peaks"]


@query("d16_bounded_median_gap", sql("v_period", "SELECT series, gap FROM v_period"))
def bounded_median_gap(spark, sf):
    return S_.bounded_median_gap(peak_points(spark, sf))


MISSING = "(CAST(round_even((b[1] - acc[len(acc)]) / per, 0) AS BIGINT) - 1)"
@query("d13_fill_missing", sql("v_period", f"""
WITH p AS (SELECT series, peaks, coalesce(gap, 22.0::DOUBLE) AS per FROM v_period),
f AS (SELECT *, list_reduce(list_transform(peaks, lambda v: [v]), lambda acc, b: list_concat(acc,
        CASE WHEN b[1] - acc[len(acc)] > 1.65 * per AND {MISSING} > 0 THEN list_transform(range(1, {MISSING} + 1), lambda j:
             CAST(round_even(acc[len(acc)] + (b[1] - acc[len(acc)]) / ({MISSING} + 1.0::DOUBLE) * j, 0) AS BIGINT)) ELSE [] END, b)) AS filled FROM p),
d AS (SELECT series, peaks, list_reduce(list_transform(filled, lambda v: [v]), lambda acc, b:
        CASE WHEN b[1] - acc[len(acc)] >= greatest(10, CAST(round_even(0.55 * per, 0) AS INTEGER)) THEN list_concat(acc, b) ELSE acc END) AS kept FROM f)
SELECT series, unnest(CASE WHEN len(peaks) >= 2 THEN kept ELSE peaks END) AS peak FROM d"""))
def fill_missing(spark, sf):
    points = cut_lineage(peak_points(spark, sf))
    return S_.fill_missing(points, periods(spark, sf, points)).select("series", F.col("p").alias("peak"))


SEPARATE = "greatest(10, CAST(round_even(0.55 * per, 0) AS INTEGER))"
# every series with its peaks, period and profile; a run that has ended carries -1 at its end
VIEWS["v_stack"] = """
  SELECT s.series, u, n, coalesce(peaks, []::BIGINT[]) AS peaks, gap, coalesce(gap, 22.0::DOUBLE) AS per
  FROM (SELECT series, count(*) AS n, list((x - lo) / ((hi - lo) + 1e-6) ORDER BY idx) AS u
        FROM (SELECT *, min(x) OVER (PARTITION BY series) AS lo, max(x) OVER (PARTITION BY series) AS hi FROM v_line) GROUP BY 1) s LEFT JOIN v_period p ON p.series = s.series"""
VIEWS["v_run"] = f"""
  SELECT k.*, coalesce(b.run, k.peaks) AS run, CASE WHEN b.run IS NULL THEN k.gap ELSE {mid('b.steps')} END AS run_period
  FROM v_stack k LEFT JOIN (
    SELECT *, list_sort(list_transform(range(1, len(run)), lambda i: CAST(run[i + 1] - run[i] AS DOUBLE))) AS steps,
           row_number() OVER (PARTITION BY series ORDER BY len(run) DESC, run[1]) AS o
    FROM (SELECT series, list_filter(list_reduce(list_transform(peaks[i:len(peaks)], lambda v: [v]), lambda acc, b:
            CASE WHEN acc[len(acc)] < 0 THEN acc WHEN b[1] - acc[len(acc)] > 34 THEN list_concat(acc, [CAST(-1 AS BIGINT)])
                 WHEN b[1] - acc[len(acc)] >= 14 THEN list_concat(acc, b) ELSE acc END), lambda v: v >= 0) AS run
          FROM (SELECT series, peaks, unnest(range(1, len(peaks) + 1)) AS i FROM v_stack WHERE len(peaks) >= 3))
    WHERE len(run) >= 3) b ON b.series = k.series AND b.o = 1"""
NEEDS.update({"v_stack": ["v_period"], "v_run": ["v_stack"]})


@query("d14_best_periodic_run", sql("v_run", "SELECT series, unnest(run) AS p, run_period FROM v_run"))
def best_periodic_run(spark, sf):
    runs, gaps = S_.best_periodic_run(peak_points(spark, sf), 14, 34, 3)
    return runs.join(gaps, "series")


@query("d14_bottom_cluster", sql("v_stack", """
WITH p AS (SELECT series, peaks, unnest(peaks) AS y, unnest(range(1, len(peaks) + 1)) AS i, greatest(12, CAST(floor(0.75 * per) AS INTEGER)) AS lo, per FROM v_stack WHERE len(peaks) >= 3),
s AS (SELECT *, CASE WHEN y - lag(y) OVER w BETWEEN lo AND greatest(lo + 1, CAST(ceil(1.15 * per) AS INTEGER)) THEN 0 ELSE 1 END AS o FROM p WINDOW w AS (PARTITION BY series ORDER BY i)),
g AS (SELECT *, sum(o) OVER (PARTITION BY series ORDER BY i) AS k FROM s),
c AS (SELECT series, k, count(*) AS n, min(y) AS y, min(i) AS i FROM g GROUP BY 1, 2 HAVING count(*) >= 3 AND min(y) >= 270),
b AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY n DESC, y DESC) AS r FROM c)
SELECT v.series, unnest(CASE WHEN b.i IS NULL THEN peaks ELSE peaks[b.i:len(peaks)] END) AS p FROM v_stack v LEFT JOIN b ON b.series = v.series AND r = 1"""))
def bottom_cluster(spark, sf):
    points = cut_lineage(peak_points(spark, sf))
    return S_.bottom_cluster(points, periods(spark, sf, points), 600, 3)


def stretched(spark, sf):
    """Run, peaks, periods, and the normalised profile repeated per pixel, so that positions and profile agree."""
    points = cut_lineage(peak_points(spark, sf))
    unit = R.minmax01(line(spark, sf)).select("series", F.explode(F.sequence(F.col("idx") * 8, F.col("idx") * 8 + 7)).alias("idx"), F.col("unit").alias("x"))
    runs, _ = S_.best_periodic_run(points, 14, 34, 3)
    return runs, points, periods(spark, sf, points), unit


SUPPORT = "greatest(0.16, s[CAST(floor(pos) AS INTEGER) // 8 + 1] + (pos - floor(pos)) * (s[CAST(ceil(pos) AS INTEGER) // 8 + 1] - s[CAST(floor(pos) AS INTEGER) // 8 + 1]))"
NEAR = "list_sort(list_transform(list_filter(peaks, lambda q: abs(q - g) <= snap), lambda q: {'d': abs(q - g), 'q': q}))[1].q"


def stepped(limit: str, place: str, more: str) -> str:
    """DuckDB text: a walk from both ends of the runs in ``r``, one row per step taken."""
    return f"""walk AS (
  SELECT series, d, CASE WHEN d < 0 THEN run[1] ELSE run[len(run)] END AS pt, 0 AS k FROM r, (SELECT unnest([-1, 1]) AS d) WHERE len(run) > 0
  UNION ALL
  SELECT series, d, t AS pt, k FROM (SELECT *, {place} AS t FROM (
    SELECT r.*, w.d, w.pt AS old, w.k + 1 AS k, CAST(round_even(w.pt + w.d * r.per, 0) AS BIGINT) AS g FROM walk w JOIN r ON r.series = w.series) q WHERE {limit}) z
  WHERE t IS NOT NULL AND {more})"""


@query("d15_extend_periodic", sql("v_run", f"""
WITH p AS (SELECT series, run, peaks, per, u, 8 * n AS size, list_sort(u) AS s, 0.55 * (8 * n - 1) AS pos, {SEPARATE} AS sep, greatest(5, CAST(round_even(0.4 * per, 0) AS INTEGER)) AS snap FROM v_run),
r AS (SELECT *, {SUPPORT} AS support FROM p),
{stepped('g >= 0 AND g <= size - 1', f'coalesce({NEAR}, CASE WHEN u[g // 8 + 1] >= support THEN g END)', 'd * (t - old) >= sep')},
j AS (SELECT r.series, sep, list_concat(list_concat((SELECT coalesce(list(pt ORDER BY k DESC), []) FROM walk w WHERE w.series = r.series AND d < 0 AND k > 0), run),
             (SELECT coalesce(list(pt ORDER BY k), []) FROM walk w WHERE w.series = r.series AND d > 0 AND k > 0)) AS a FROM r)
SELECT series, unnest(list_reduce(list_transform(a, lambda v: [v]), lambda acc, b: CASE WHEN b[1] - acc[len(acc)] >= sep THEN list_concat(acc, b) ELSE acc END)) AS p FROM j WHERE len(a) > 0""", recursive=True))
def extend_periodic(spark, sf):
    runs, points, gaps, unit = stretched(spark, sf)
    return S_.extend_periodic(runs, points, gaps, unit)


@query("d15_extend_supported", sql("v_run", f"""
WITH r AS (SELECT series, run, per, u, 8 * n AS size, greatest(4, CAST(round_even(0.22 * per, 0) AS INTEGER)) AS half FROM v_run),
{stepped('g >= 0 AND g < size', "CASE WHEN list_avg(list_transform(range(greatest(0, g - half), least(size - 1, g + half) + 1), lambda i: u[i // 8 + 1])) >= 0.12 THEN g END", 'k <= CASE WHEN d < 0 THEN 4 ELSE 2 END')}
SELECT r.series, unnest(list_concat(list_concat((SELECT coalesce(list(pt ORDER BY k DESC), []) FROM walk w WHERE w.series = r.series AND d < 0 AND k > 0), run),
       (SELECT coalesce(list(pt ORDER BY k), []) FROM walk w WHERE w.series = r.series AND d > 0 AND k > 0))) AS p FROM r""", recursive=True))
def extend_supported(spark, sf):
    runs, _, gaps, unit = stretched(spark, sf)
    return S_.extend_supported(runs, gaps, unit, 0.12)


@query("d17_pair_bands", sql("v_peaks", """
WITH y AS (SELECT series, unnest(peaks) AS y FROM v_peaks), n AS (SELECT *, lead(y) OVER (PARTITION BY series ORDER BY y) AS to_y FROM y)
SELECT series, y, to_y, to_y - y AS distance, CASE WHEN to_y - y BETWEEN 16 AND 30 OR (y >= 200 AND to_y <= 320) THEN NULL
       WHEN to_y - y > 30 THEN 'alto' ELSE 'bajo' END AS reason FROM n WHERE to_y IS NOT NULL"""))
def pair_bands(spark, sf):
    seams = peak_points(spark, sf).withColumnRenamed("p", "y")
    return R.pair_bands(seams, 16.0, 30.0, "y >= 200 AND to_y <= 320")


def trend_text(source: str, value: str) -> str:
    """Chain of CTE texts of the trimmed trend; the last one is ``trended``."""
    steps = [f"t0 AS (SELECT *, true AS sel, false AS done, NULL::DOUBLE AS trend, count(*) OVER ({S}) AS cnt FROM {source})"]
    fit = f"regr_slope(CASE WHEN sel THEN {value} END, CASE WHEN sel THEN y END) OVER ({S}) AS fb, regr_intercept(CASE WHEN sel THEN {value} END, CASE WHEN sel THEN y END) OVER ({S}) AS fa"
    for i in range(4):
        steps.append(f"a{i} AS (SELECT *, count(*) FILTER (WHERE sel) OVER ({S}) AS c, {fit} FROM t{i})")
        steps.append(f"b{i} AS (SELECT * REPLACE (CASE WHEN NOT done AND c >= 5 AND cnt >= 6 THEN fa + fb * y ELSE trend END AS trend), NOT done AND c >= 5 AND cnt >= 6 AS go FROM a{i})")
        steps.append(f"c{i} AS (SELECT *, list_sort(list(abs({value} - trend)) FILTER (WHERE sel) OVER ({S})) AS dev FROM b{i})")
        steps.append(f"d{i} AS (SELECT *, abs({value} - trend) <= greatest(12.0, 2.8 * ({mid('dev')} + 1e-6)) AS fresh FROM c{i})")
        steps.append(f"e{i} AS (SELECT *, count(*) FILTER (WHERE fresh) OVER ({S}) AS k FROM d{i})")
        steps.append(f"t{i + 1} AS (SELECT * EXCLUDE (c, fb, fa, go, dev, fresh, k) REPLACE (done OR NOT go OR k = c AS done, CASE WHEN go THEN fresh ELSE sel END AS sel) FROM e{i})")
    steps.append(f"a4 AS (SELECT *, count(*) FILTER (WHERE sel) OVER ({S}) AS c, {fit} FROM t4)")
    steps.append("trended AS (SELECT * EXCLUDE (sel, done, c, fb, fa) REPLACE (CASE WHEN trend IS NOT NULL AND c >= 5 THEN fa + fb * y ELSE trend END AS trend) FROM a4)")
    return ",\n".join(steps)


@query("d18_trimmed_trend", sql("v_line", f"WITH {trend_text('v_line', 'x')} SELECT series, idx, round(trend, 6) AS trend FROM trended"))
def trimmed_trend(spark, sf):
    return shown(S_.trimmed_trend(line(spark, sf)), "trend")


def near(value: str, r: int) -> str:
    return f"list_sort(list({value}) OVER (w ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING))"


def smooth3(value: str) -> str:
    return f"list_sort([coalesce(lag({value}) OVER w, {value}), {value}, coalesce(lead({value}) OVER w, {value})])[2]"


@query("d19_stabilise", sql("v_line", f"""
WITH m AS (SELECT *, {near('x', 2)} AS a, {near('x', 4)} AS b, count(*) OVER ({S}) AS n FROM v_line {W}),
g AS (SELECT *, 0.45 * {mid('a')} + 0.55 * {mid('b')} AS g, idx < greatest(6, CAST(round_even(0.35 * n, 0) AS INTEGER)) AS top FROM m),
c AS (SELECT *, CASE WHEN abs(x - g) > 24 OR (top AND x - g > 16) THEN 0.25 * x + 0.75 * g ELSE x END AS c FROM g),
o AS (SELECT *, abs(c - g) <= 18 AS ok FROM c),
f AS (SELECT *, count(*) FILTER (WHERE ok) OVER ({S}) AS k, regr_slope(CASE WHEN ok THEN c END, CASE WHEN ok THEN y END) OVER ({S}) AS fb,
             regr_intercept(CASE WHEN ok THEN c END, CASE WHEN ok THEN y END) OVER ({S}) AS fa FROM o),
t AS (SELECT *, CASE WHEN k >= greatest(8, CAST(round_even(0.45 * n, 0) AS INTEGER)) THEN fa + fb * y END AS t FROM f),
d AS (SELECT series, idx, n, x, CASE WHEN abs(c - t) > 26 OR (top AND c - t > 18) THEN 0.2 * c + 0.8 * t ELSE c END AS v FROM t)
SELECT series, idx, round(CASE WHEN n < 5 THEN x ELSE {smooth3('v')} END, 6) AS stable FROM d {W}"""))
def stabilise(spark, sf):
    return shown(S_.stabilise(line(spark, sf)), "stable")


@query("d19_consistent_curve", sql("v_line", f"""
WITH m AS (SELECT *, {near('x', 2)} AS ma, {near('x', 5)} AS mb, count(*) OVER ({S}) AS n FROM v_line {W}),
g AS (SELECT * EXCLUDE (ma, mb), 0.65 * {mid('ma')} + 0.35 * {mid('mb')} AS g FROM m),
{trend_text('g', 'g')},
p AS (SELECT *, coalesce(trend, g) AS p, idx < greatest(6, CAST(round_even(0.4 * n, 0) AS INTEGER)) AS top FROM trended),
d AS (SELECT series, idx, n, x, CASE WHEN x - p > 26 OR abs(x - g) > 34 OR (top AND x - p > 16) THEN 0.18 * x + 0.82 * p WHEN p - x > 34 THEN 0.28 * x + 0.72 * p ELSE x END AS v FROM p)
SELECT series, idx, round(CASE WHEN n < 6 THEN x ELSE {smooth3('v')} END, 6) AS curve FROM d {W}"""))
def consistent_curve(spark, sf):
    return shown(S_.consistent_curve(line(spark, sf)), "curve")


@query("d19_repair_low_confidence", sql("v_line", f"""
WITH m AS (SELECT *, {near('x', 2)} AS a, count(*) OVER ({S}) AS n, count(*) FILTER (WHERE conf >= 0.55) OVER ({S}) AS hi, count(*) FILTER (WHERE conf >= 0.4) OVER ({S}) AS lo FROM v_line {W}),
u AS (SELECT *, CASE WHEN hi >= 6 THEN conf >= 0.55 WHEN lo >= 4 THEN conf >= 0.4 ELSE true END AS ok FROM m),
f AS (SELECT *, regr_slope(CASE WHEN ok THEN x END, CASE WHEN ok THEN y END) OVER ({S}) AS fb, regr_intercept(CASE WHEN ok THEN x END, CASE WHEN ok THEN y END) OVER ({S}) AS fa FROM u),
p AS (SELECT *, 0.58 * (fa + fb * y) + 0.42 * {mid('a')} AS p, idx < greatest(6, CAST(round_even(0.45 * n, 0) AS INTEGER)) AS top FROM f),
d AS (SELECT series, idx, n, x, CASE WHEN conf < 0.18 THEN p WHEN conf < 0.35 AND abs(x - p) > 8 THEN 0.1 * x + 0.9 * p WHEN conf < 0.52 AND top AND x - p > 6 THEN 0.18 * x + 0.82 * p
             WHEN conf < 0.52 AND abs(x - p) > 11 THEN 0.24 * x + 0.76 * p ELSE x END AS v FROM p)
SELECT series, idx, round(CASE WHEN n < 6 THEN x ELSE {smooth3('v')} END, 6) AS repaired FROM d {W}"""))
def repair_low_confidence(spark, sf):
    return shown(S_.repair_low_confidence(line(spark, sf)), "repaired")


@query("d20_edge_pick", sql("v_line", f"""
WITH c AS (SELECT series, max(x) AS top, greatest(0.35 * max(x), quantile_cont(x, 0.75)) AS cut, max(idx) AS e FROM v_line GROUP BY 1)
SELECT v.series, CAST(min(idx) FILTER (WHERE x >= cut) AS DOUBLE) AS leftmost, CAST(max(idx) FILTER (WHERE x >= cut) AS DOUBLE) AS rightmost,
       CAST(min(idx) FILTER (WHERE x = top) AS DOUBLE) AS strongest FROM v_line v JOIN c USING (series) GROUP BY 1"""))
def edge_pick(spark, sf):
    rows = line(spark, sf)
    pick = lambda mode: R.edge_pick(rows, mode).select("series", F.col("edge").alias(mode))
    return pick("leftmost").join(pick("rightmost"), "series").join(pick("strongest"), "series")


@query("d21_separator_pick", sql("v_line", f"""
WITH q AS (SELECT *, count(*) OVER ({S}) AS n, lag(x) OVER w AS l, lead(x) OVER w AS r FROM v_line {W}),
c AS (SELECT series, greatest(0.2 * max(x), quantile_cont(x, 0.7)) AS cut FROM v_line GROUP BY 1),
k AS (SELECT q.series, list(idx ORDER BY x DESC, idx DESC) AS c FROM q JOIN c USING (series) WHERE x >= cut AND x >= l AND x >= r
        AND idx >= greatest(2, CAST(round_even(0.18 * n, 0) AS INTEGER)) AND idx < n - greatest(2, CAST(round_even(0.18 * n, 0) AS INTEGER)) GROUP BY 1),
f AS (SELECT series, list_reduce(list_transform(c, lambda v: [v]), lambda acc, b: CASE WHEN len(list_filter(acc, lambda k: abs(k - b[1]) < 4.0)) > 0 THEN acc ELSE list_concat(acc, b) END)[1:3] AS s FROM k)
SELECT series, unnest(s) AS p FROM f WHERE len(s) = 3"""))
def separator_pick(spark, sf):
    return S_.separator_pick(line(spark, sf), 3, 4.0, 0.2)


VIEWS["v_crossing"] = f"""
  SELECT series, min(idx) FILTER (WHERE idx >= 4 AND idx < n - 6 AND l >= 11.9 AND r <= 8.9 AND g >= 0.06) AS crossing, list(x ORDER BY idx) AS xs,
         CAST(max(idx) FILTER (WHERE x >= 8) AS DOUBLE) AS candidate
  FROM (SELECT *, count(*) OVER ({S}) AS n, avg(x) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS l, avg(x) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS r,
               greatest(coalesce(lag(conf) OVER w, conf), conf, coalesce(lead(conf) OVER w, conf)) AS g FROM v_line {W}) GROUP BY 1"""
NEEDS["v_crossing"] = ["v_line"]


@query("d22_threshold_crossing", sql("v_line", f"""
WITH g AS (SELECT *, count(*) OVER ({S}) AS n, avg(x) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS l, avg(x) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS r,
                  greatest(coalesce(lag(conf) OVER w, conf), conf, coalesce(lead(conf) OVER w, conf)) AS g FROM v_line {W})
SELECT series, min(idx) FILTER (WHERE idx >= 4 AND idx < n - 6 AND l >= 11.9 AND r <= 8.9 AND g >= 0.06) AS crossing FROM g GROUP BY 1"""))
def threshold_crossing(spark, sf):
    return R.threshold_crossing(line(spark, sf).withColumn("neg", F.col("conf")), 11.0, 5.0)


def stretch(a: int, b: int, default: float) -> str:
    part = f"list_sort(xs[greatest(0, crossing + {a}) + 1:greatest(0, least(len(xs), crossing + {b}))])"
    return f"coalesce(CASE WHEN len({part}) > 0 THEN {mid(part)} END, {default})"


@query("d22_pull_back", sql("v_crossing", f"""
WITH m AS (SELECT *, {stretch(-56, -26, 11.0)} AS body, {stretch(-22, -6, 11.0)} AS l, {stretch(4, 18, 5.0)} AS r FROM v_crossing)
SELECT series, crossing, candidate, round(CASE WHEN crossing IS NULL OR candidate <= crossing + 6 OR greatest(0.0, l - r) < 10 OR greatest(0.0, 1.0 - abs(body - 11.0) / 16.0) < 0.22 THEN candidate
       WHEN candidate - crossing > 12 THEN crossing ELSE 0.85 * crossing + 0.15 * candidate END, 6) AS pulled FROM m"""))
def pull_back(spark, sf):
    """Late candidates (the last strong idx) against the first crossing of their series."""
    rows = line(spark, sf).withColumn("neg", F.col("conf"))
    crossing = R.threshold_crossing(rows, 11.0, 5.0)
    candidate = rows.groupBy("series").agg(F.expr("cast(max(CASE WHEN x >= 8 THEN idx END) AS double)").alias("candidate"))
    return S_.pull_back(rows, crossing, candidate, 11.0, 5.0).select("series", "crossing", "candidate", r6("pulled").alias("pulled"))


NEED = "greatest(1, CAST(round_even((1.0 - b[1].idx / greatest(1.0, e::DOUBLE)) * 2 + b[1].idx / greatest(1.0, e::DOUBLE) * 6, 0) AS INTEGER))"


@query("d23_progressive_peaks", sql("v_line", f"""
WITH c AS (SELECT series, list({{'idx': idx, 'x': x}} ORDER BY idx) AS c FROM (SELECT *, {PEAK.format('4.0')} AS p FROM v_line {W}) WHERE p GROUP BY 1),
n AS (SELECT series, max(idx) AS e FROM v_line GROUP BY 1),
f AS (SELECT series, list_reduce(list_transform(c, lambda v: [v]), lambda acc, b: CASE WHEN b[1].idx - acc[len(acc)].idx >= {NEED} THEN list_concat(acc, b)
        WHEN b[1].x > acc[len(acc)].x THEN list_concat(acc[1:len(acc) - 1], b) ELSE acc END) AS k FROM c JOIN n USING (series))
SELECT series, unnest(list_transform(k, lambda v: v.idx)) AS p FROM f"""))
def progressive_peaks(spark, sf):
    return S_.progressive_peaks(line(spark, sf), 4.0, 2, 6)


@query("c17_combine_profiles", sql("v_profile", f"""
WITH u AS (SELECT (CAST(series AS BIGINT) // 4)::VARCHAR AS series, idx,
             greatest(1e-4, least(1.0, (value - min(value) OVER s) / ((max(value) OVER s - min(value) OVER s) + 1e-6))) AS x FROM v_profile WINDOW s AS (PARTITION BY series)),
c AS (SELECT series, idx, 0.45 * {mid('list_sort(list(x))')} + 0.55 * exp(avg(ln(x))) AS x FROM u GROUP BY 1, 2)
SELECT series, idx, round((x - min(x) OVER s) / ((max(x) OVER s - min(x) OVER s) + 1e-6), 6) AS x FROM c WINDOW s AS (PARTITION BY series)"""))
def combine_profiles(spark, sf):
    strips = R.minmax01(line(spark, sf)).select(
        F.expr("cast(cast(series AS bigint) div 4 AS string)").alias("group"), "series", "idx", "unit"
    )
    return shown(R.combine_profiles(strips.select(F.col("group").alias("series"), F.col("series").alias("strip"), "idx", F.col("unit").alias("x"))), "x")
