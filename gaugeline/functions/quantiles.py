"""Exact medians of groups that may hold most of the data, by radix selection.

The built-in percentile gathers the distinct values of a group in one task. Here a double becomes a long whose order is that
of the doubles, and the middle ranks are narrowed from its leading bits to its last: a histogram of 22 bits tells which bucket
holds them, one of the next 21 bits inside that bucket goes on, and the last 21 bits leave single values. A histogram is a
partial aggregate with a bounded number of rows per group; values are neither shuffled nor sorted, whatever their spread is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.session import cut_lineage

#: Bits below the digits of each round.
SHIFTS = (42, 21, 0)
#: Groups up to which their one or two buckets are broadcast.
FEW_GROUPS = 10_000


def with_order_bits(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds a long that sorts like the double: the bits of its size, negated for negative values. Both zeros are 0; NaN comes last.

    The steps are columns of their own, so that each is computed once: a logarithm gives the exponent or a neighbour of it, and
    the quotient by that power of two, which is exact, tells which and holds the mantissa.
    """
    v, size, ratio = F.col(value), F.col("_size"), F.col("_ratio")
    proper = (size > 0) & (size < float("inf"))
    near = F.least(F.greatest(F.floor(F.log2(F.when(proper, size))).cast("double"), F.lit(-1022.0)), F.lit(1023.0))
    rows = df.withColumn("_size", F.abs(v)).withColumn("_near", near).withColumn("_ratio", F.when(proper, size / F.pow(F.lit(2.0), F.col("_near"))))
    shift = F.when(ratio >= 2, 1).when((ratio < 1) & (F.col("_near") > -1022), -1).otherwise(0)
    part = (F.when(shift == 1, ratio / 2).when(shift == -1, ratio * 2).otherwise(ratio) * F.lit(2.0**52)).cast("long")
    # a mantissa of one and more counts an exponent itself; below the smallest normal double there is none
    normal = (F.col("_near").cast("long") + shift + 1022) * F.lit(1 << 52) + part
    bits = F.when(size == 0, F.lit(0).cast("long")).when(F.isnan(size), F.lit((1 << 63) - 1)).when(size == float("inf"), F.lit(2047 << 52)).otherwise(normal)
    return rows.withColumn("_bits_", bits).withColumn(name, F.when((v < 0) & ~F.isnan(v), -F.col("_bits_")).otherwise(F.col("_bits_"))).drop("_size", "_near", "_ratio", "_bits_")


def exact_median(df: DataFrame, keys: list[str], name: str = "median", value: str = "v", weight: str | None = None, few: int = FEW_GROUPS) -> DataFrame:
    """Median per group, null values left out: rows (keys, name, total). With `weight`, a row counts that often."""
    found = ranked_values(df, keys, 0.5, value, weight, few)
    return found.select(*keys, (0.5 * (F.col("low") + F.col("high"))).alias(name), "total")


def exact_quantile(df: DataFrame, keys: list[str], share: float, name: str, value: str = "v", few: int = FEW_GROUPS) -> DataFrame:
    """The value at the given share of the order, between two values in proportion: rows (keys, name, total)."""
    found = ranked_values(df, keys, share, value, None, few)
    part = F.lit(share) * (F.col("total") - 1) - F.floor(F.lit(share) * (F.col("total") - 1))
    return found.select(*keys, (F.col("low") + part * (F.col("high") - F.col("low"))).alias(name), "total")


def ranked_values(df: DataFrame, keys: list[str], share: float, value: str = "v", weight: str | None = None, few: int = FEW_GROUPS) -> DataFrame:
    """The values on both sides of a share of the order: rows (keys, low, high, total)."""
    times = F.col(weight) if weight else F.lit(1)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), times.cast("long").alias("_times"))
    # written once: else the optimiser spells the bits out anew wherever a round compares them
    rows = cut_lineage(with_order_bits(rows, "_v", "_bits"))
    held, small, above, kept = None, False, 0, keys
    for shift in SHIFTS:
        inside = rows
        if held is not None:
            # keys of the right side have names of their own
            found = held.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_prefix", "_before", "_total")
            same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
            inside = rows.join(F.broadcast(found) if small else found, [*same, F.shiftright("_bits", above) == F.col("_prefix")])
            kept = [*keys, "_prefix", "_before", "_total"]
        counts = inside.groupBy(*kept, F.shiftright("_bits", shift).alias("_digit")).agg(F.sum("_times").alias("_held"), F.min("_v").alias("_v"))
        upto = F.sum("_held").over(Window.partitionBy(*kept).orderBy("_digit"))
        if held is None:
            placed = counts.withColumn("_upto", upto).withColumn("_total", F.sum("_held").over(Window.partitionBy(*keys)))
        else:
            placed = counts.withColumn("_upto", upto + F.col("_before"))
        place = F.lit(share) * (F.col("_total") - 1)
        low, high = F.floor(place) + 1, F.ceil(place) + 1
        middle = placed.where((F.col("_upto") >= low) & (F.col("_upto") - F.col("_held") < high))
        held = middle.select(*keys, F.col("_digit").alias("_prefix"), (F.col("_upto") - F.col("_held")).alias("_before"), "_total", "_upto", "_v")
        if shift == SHIFTS[0]:
            held = cut_lineage(held)
            small = held.count() <= 2 * few
        above = shift
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.struct("_upto", "_v")))["_v"]
    return held.groupBy(*keys).agg(at(low).alias("low"), at(high).alias("high"), F.first("_total").alias("total"))
