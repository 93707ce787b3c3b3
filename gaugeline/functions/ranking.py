"""Row numbers over groups of any size, without sorting a whole group in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.session import cut_lineage

ROWS_PER_BUCKET = 50_000


def hash_rank(df: DataFrame, key: str, seed: int, groups: list[str], name: str = "rank") -> DataFrame:
    """Rank rows of each group (or of the whole table) in a seeded random order.

    Adds the rank and the ``total`` of the group.  The order is md5(seed:key), key.  The first
    digits of the hash, as many as the number of rows asks for, split a group into even
    buckets; counts of the buckets give every bucket its first rank.  The rows are written
    once, as both the counts and the ranks need them.
    """
    hashed = cut_lineage(df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))))
    digits = max(1, math.ceil(math.log(max(1, hashed.count() / ROWS_PER_BUCKET), 16)))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, digits))
    sizes = hashed.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    starts = sizes.select(
        *groups, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("total")
    )
    inside = Window.partitionBy(*groups, "_b").orderBy("_h", key)
    return (
        hashed.withColumn("_r", F.row_number().over(inside))
        .join(starts, [*groups, "_b"])
        .withColumn(name, F.col("_start") + F.col("_r"))
        .drop("_h", "_b", "_r", "_start")
    )
