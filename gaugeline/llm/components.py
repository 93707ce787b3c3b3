"""Connected components of links between long ids, by alternating star operations.

Each round rewires links to the smallest neighbour, first among all neighbours, then among the smaller ones, until all links
are stars: every id has one link to a smaller one, or is where such links end. Links never outnumber the input. Rounds are cut
by checkpoints in the shared folder. Nothing but a count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _open_ids(links: DataFrame) -> int:
    """How many ids have several links to smaller ids, or one while others end at them."""
    ends = links.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").count()


def components(links: DataFrame) -> DataFrame:
    """From links `u`, `v` (longs): `node`, `component` (the smallest id of its component) for every id that has a link to a smaller one."""
    pair = links.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    now = cut_lineage(pair.where("u <> v").distinct())
    while _open_ids(now):
        now = cut_lineage(_small_star(_large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
