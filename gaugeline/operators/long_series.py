"""Profiles too long for one task: blocks with copied borders, walks as graphs, greedy rounds, grouped sums.

A series of any length is dealt in blocks of `BLOCK` neighbouring places, and no step sees more of it than a block, its borders
and a row per block. The forms in `profiles` fold or sort one series at a time; they take the short series, these the long ones,
and both give the same rows.

* Windows run per block after `spread` has copied the rows at its borders from its neighbours.
* A walk (thinning, regular runs, extensions, growing distances) gives every point one next point. Inside a block it is followed
  to where it leaves the block; those exits form a graph with few nodes, in which jumps of doubled length are joined; the blocks
  that a walk enters then mark its points.
* Greedy spacing keeps a candidate that has no undecided stronger one near it and drops the neighbours of kept ones, in rounds.
  A round decides everything in a block but what hangs on an undecided candidate beyond its border.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.session import cut_lineage

BLOCK = 1 << 14


def split_by_length(df: DataFrame, most: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the series with at most `most` rows, and of the longer ones (None if there are none)."""
    counts = df.groupBy("series").count()
    if (counts.agg(F.max("count")).first()[0] or 0) <= most:
        return df, None
    long = cut_lineage(counts.where(F.col("count") > most).select("series"))
    return df.join(long, "series", "left_anti"), df.join(long, "series", "left_semi")


# Blocks ---------------------------------------------------------------------------------------------


def spread(df: DataFrame, before: int, after: int, block: int = BLOCK, place: str = "idx") -> DataFrame:
    """Every row in its block `_block`, and copies in the blocks that see it among their borders. `inner` drops the copies."""
    at = F.col(place)
    first, last = F.floor((at - after) / F.lit(block)), F.floor((at + before) / F.lit(block))
    return df.withColumn("_block", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.greatest(last, F.lit(0)))))


def inner(df: DataFrame, block: int = BLOCK, place: str = "idx") -> DataFrame:
    return df.where(F.floor(F.col(place) / F.lit(block)) == F.col("_block")).drop("_block")


def numbered(points: DataFrame, block: int = BLOCK, place: str = "p") -> DataFrame:
    """Adds `pos`, the number of a point in its series from 0. Places are whole and not negative."""
    part = F.floor(F.col(place) / F.lit(block))
    blocked = points.withColumn("_part", part)
    before = F.sum("_n").over(Window.partitionBy("series").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    held = blocked.groupBy("series", "_part").agg(F.count(F.lit(1)).alias("_n")).select("series", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("series", "_part").orderBy(place)) - 1
    return blocked.withColumn("_inside", inside).join(held, ["series", "_part"]).withColumn("pos", (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_inside", "_before")


# Walks ----------------------------------------------------------------------------------------------

#: From the points of a block and its border, in order: the place in that list of each point's next point, -1 for none.
Rule = Callable[[pd.DataFrame], np.ndarray]


def linked(points: DataFrame, rule: Rule, ahead: int, block: int = BLOCK) -> DataFrame:
    """Points (series, pos, ...) with `next` (a pos), `leave` (the first pos of the walk in another block) and `steps` (points until then).

    A next point lies at most `ahead` numbers on.
    """
    shape = f"series {points.schema['series'].dataType.simpleString()}, pos long, next long, leave long, steps long"

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").reset_index(drop=True)
        target = rule(rows)
        pos, n = rows["pos"].to_numpy(), int((rows["pos"] // block == rows["_block"]).sum())
        leave, steps = np.full(n, -1, np.int64), np.ones(n, np.int64)
        for i in range(n - 1, -1, -1):
            t = target[i]
            if t >= n:
                leave[i] = pos[t]
            elif t >= 0:
                leave[i], steps[i] = leave[t], steps[t] + 1
        next_ = np.where(target[:n] >= 0, pos[np.maximum(target[:n], 0)], -1)
        out = pd.DataFrame({"series": rows["series"].to_numpy()[:n], "pos": pos[:n]})
        for name, values in (("next", next_), ("leave", leave)):
            out[name] = pd.array(values, "Int64")
            out.loc[values < 0, name] = pd.NA
        out["steps"] = steps
        return out

    made = spread(points, 0, ahead, block, "pos").groupBy("series", "_block").applyInPandas(follow, shape)
    return cut_lineage(made)


def _entries(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """The nodes at which walks enter blocks or start: series, pos, leave, steps."""
    doors = nodes.where("leave IS NOT NULL").select("series", F.col("leave").alias("pos")).union(starts.select("series", "pos")).distinct()
    return nodes.select("series", "pos", "leave", "steps").join(doors, ["series", "pos"], "left_semi")


def walked(nodes: DataFrame, starts: DataFrame, block: int = BLOCK) -> DataFrame:
    """The points (series, pos) that the walks from `starts` reach, the starts among them."""
    jump = cut_lineage(_entries(nodes, starts).select("series", "pos", F.col("leave").alias("to")))
    reached = cut_lineage(starts.select("series", "pos").distinct())
    while True:
        # jumps have double length each time, so the reached entries of a walk double too
        more = reached.join(jump, ["series", "pos"]).where("to IS NOT NULL").select("series", F.col("to").alias("pos"))
        if more.isEmpty():
            break
        reached = cut_lineage(reached.union(more).distinct())
        onward = jump.select("series", F.col("pos").alias("to"), F.col("to").alias("far"))
        jump = cut_lineage(jump.join(onward, ["series", "to"], "left").select("series", "pos", F.col("far").alias("to")))
    shape = f"series {nodes.schema['series'].dataType.simpleString()}, pos long"

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").reset_index(drop=True)
        on = rows["entered"].to_numpy().copy()
        place = {p: i for i, p in enumerate(rows["pos"])}
        for i, target in enumerate(rows["next"]):
            if on[i] and not pd.isna(target) and int(target) in place:
                on[place[int(target)]] = True
        return rows.loc[on, ["series", "pos"]]

    marks = nodes.join(reached.withColumn("entered", F.lit(True)), ["series", "pos"], "left").select(
        "series", "pos", "next", F.coalesce("entered", F.lit(False)).alias("entered"), F.floor(F.col("pos") / F.lit(block)).alias("_block")
    )
    return marks.groupBy("series", "_block").applyInPandas(mark, shape)


def walk_lengths(nodes: DataFrame) -> DataFrame:
    """How many points the walk from each point has: series, pos, n."""
    none = nodes.select("series", "pos").limit(0)
    jump = cut_lineage(_entries(nodes, none).select("series", "pos", F.col("leave").alias("to"), F.col("steps").alias("n")))
    while jump.where("to IS NOT NULL").limit(1).count():
        onward = jump.select("series", F.col("pos").alias("to"), F.col("to").alias("far"), F.col("n").alias("more"))
        jump = cut_lineage(jump.join(onward, ["series", "to"], "left").select("series", "pos", F.col("far").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
    rest = jump.select("series", F.col("pos").alias("leave"), F.col("n").alias("rest"))
    return nodes.join(rest, ["series", "leave"], "left").select("series", "pos", (F.col("steps") + F.coalesce("rest", F.lit(0))).alias("n"))


# Greedy spacing ---------------------------------------------------------------------------------------


def spaced(candidates: DataFrame, distance: int, late: bool = False, block: int = BLOCK) -> DataFrame:
    """Of candidates (series, idx, x) those that a pass from strong to weak keeps, each `distance` or more from all kept before.

    On equal x the smaller idx comes first, with `late` the larger one. Rows (series, idx, x).
    """
    kind = candidates.schema["series"].dataType.simpleString()
    shape = f"series {kind}, idx long, x double, state int"

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        """state 0: open, 1: kept, 2: dropped. The border of a block is seen, but decided in its own block."""
        idx, x, state = rows["idx"].to_numpy(), rows["x"].to_numpy(), rows["state"].to_numpy().copy()
        low = int(rows["_block"].iloc[0]) * block
        own = (idx >= low) & (idx < low + block)
        kept, open_ = np.zeros(block + 4 * distance, bool), np.zeros(block + 4 * distance, bool)
        at = idx - low + 2 * distance
        kept[at[state == 1]] = True
        for i in np.lexsort((-idx if late else idx, -x)):
            if state[i]:
                continue
            near = slice(at[i] - distance + 1, at[i] + distance)
            if own[i]:
                state[i] = 2 if kept[near].any() else 0 if open_[near].any() else 1
            if state[i] == 1:
                kept[at[i]] = True
            elif not state[i]:
                open_[at[i]] = True
        return rows.assign(state=state).loc[own, ["series", "idx", "x", "state"]]

    live = candidates.select("series", F.col("idx").cast("long").alias("idx"), F.col("x").cast("double").alias("x"), F.lit(0).alias("state"))
    while True:
        done = cut_lineage(spread(live, distance, distance, block).groupBy("series", "_block").applyInPandas(decide, shape))
        live = done.where("state < 2")
        if live.where("state = 0").isEmpty():
            return live.select("series", "idx", "x")
