"""Mixing sources to target weights along a time-varying curriculum, with DataFrame expressions only.

Each source has a weight schedule over training time t in [0, 1]: w(t) = w * (1 + slope * (2t - 1)), whose integral is w.
Target tokens share the total by w, none above `most` times its source's size; the excess is shared again by weight.
A source is read pass after pass in the order of a seeded hash. The integrated schedule is its cumulative demand,
D(t) = target * (t + slope * (t*t - t)), and D(1) = target. The demand is inverted for the middle token of each copy: the time
it gives is the copy's training position, and a copy whose middle the demand never reaches is not taken. Documents are
range-sorted by position.

Prefix sums run per (source, hash slice): slices are summed first, so that a source with a third of all rows is spread
over many tasks. Null texts have size 0 and are never placed. A null source is a source, last in order. Rows that share an
id are placed each for itself, equal rows at positions of their own. An empty table gives an empty mix. Of the documents only
id, text and source are read, so that extra columns of any name do no harm; a text of any length is one count of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.llm.common import PLAIN_WORD
from gaugeline.session import broadcast_if_small, cut_lineage

WEIGHTS = (1.0, 2.0, 3.0)
SLOPES = (0.5, 0.0, -0.5)
MOST = 3.0
ROWS_PER_SLICE = 20_000


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    n = F.coalesce(F.regexp_count(F.col(text), F.lit(PLAIN_WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n.alias("size"))


def targets(sized: DataFrame, weights=WEIGHTS, slopes=SLOPES, most: float = MOST) -> DataFrame:
    """One row per source: `source_size`, `n_rows`, `weight`, `slope`, `target`.

    Sources are few; their windows run over one row per source. The level that fills up all sources is found by ordering
    them by size over weight: those that reach their limit are the first ones in that order.
    """
    one = W.partitionBy(F.lit(0))
    by_name, by_limit = one.orderBy(F.col("source").asc_nulls_last()), one.orderBy("limit_ratio", F.col("source").asc_nulls_last())
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), ((F.col("place") - 1) % len(values) + 1).cast("int"))
    upto = by_limit.rowsBetween(W.unboundedPreceding, W.currentRow)
    after = by_limit.rowsBetween(W.currentRow, W.unboundedFollowing)
    ranked = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
        .withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", pick(weights)).withColumn("slope", pick(slopes))
        .withColumn("limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("limit_ratio", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(one))
        # level: what a unit of weight gets if all sources before this one have reached their limit
        .withColumn("level", (F.col("total") - (F.sum("limit").over(upto) - F.col("limit"))) / F.sum("weight").over(after))
        .withColumn("free", F.col("limit_ratio") >= F.col("level"))
    )
    found = F.min(F.when(F.col("free"), F.struct("limit_ratio", "level"))).over(one)["level"]
    return ranked.withColumn("found", found).select(
        "source", "source_size", "n_rows", "weight", "slope",
        F.when(F.col("found").isNull() | (F.col("limit_ratio") < F.col("found")), F.col("limit")).otherwise(F.col("weight") * F.col("found")).alias("target"),
    )


def order_key(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary"))


def _same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def plan_mix(sized: DataFrame, weights=WEIGHTS, slopes=SLOPES, most: float = MOST, seed: int = 0) -> DataFrame:
    """Each row with its source's figures and `before`, the words of its source in front of it in one pass."""
    goal = targets(sized, weights, slopes, most).withColumn("slices", F.greatest(F.lit(1), F.expr(f"cast(ceil(n_rows / {float(ROWS_PER_SLICE)}) as bigint)")))
    keyed = (
        sized.withColumn("ord", order_key(seed)).alias("a").join(broadcast_if_small(goal).alias("b"), _same_source("a", "b"))
        .select("a.doc_id", "a.source", "a.size", "a.ord", "b.source_size", "b.slope", "b.target", "b.slices")
        # the first 15 hex digits as a fraction give slices in the order of the hash
        .withColumn("slice", F.least(F.floor(F.conv(F.substring("ord", 1, 13), 16, 10).cast("double") / F.lit(float(16**13)) * F.col("slices")), F.col("slices") - 1).cast("long"))
    )
    sums = keyed.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    starts = sums.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = W.partitionBy("source", "slice").orderBy("ord", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    laid = keyed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return (
        laid.alias("a").join(starts.alias("b"), _same_source("a", "b") & (F.col("a.slice") == F.col("b.slice")))
        .select(*[f"a.{c}" for c in ("doc_id", "source", "size", "source_size", "target", "slope")], (F.col("b.slice_start") + F.col("a.inner")).alias("before"))
    )


def position(share: Column, slope: Column) -> Column:
    """t in [0, 1] with t + slope * (t * t - t) = share."""
    rising = (slope - 1 + F.sqrt(F.greatest((1 - slope) * (1 - slope) + 4 * slope * share, F.lit(0.0)))) / (2 * slope)
    return F.when(slope == 0, share).otherwise(F.least(F.greatest(rising, F.lit(0.0)), F.lit(1.0)))


def demand_times(target: Column, source_size: Column, slope: Column, before: Column, size: Column) -> Column:
    """When the demand of a source reaches the middle of each copy of a document, one entry a pass; passes that it never reaches are left out."""
    passes = F.ceil(target / source_size).cast("int")
    share = lambda n: (n * source_size + (before + size / F.lit(2.0))) / target
    times = F.transform(F.sequence(F.lit(0), passes - 1), lambda n: F.when(share(n) <= 1, position(share(n), slope)))
    return F.when((size > 0) & (target > 0), F.filter(times, lambda t: t.isNotNull())).otherwise(F.array().cast("array<double>"))


def schedule(planned: DataFrame, partitions: int | None = None) -> DataFrame:
    """Per document: `doc_id`, `source`, `size`, `source_size`, `target`, `taken`, and the `positions` of its copies.

    Rows are range-sorted by the first position; documents without a place come last.
    """
    timed = planned.withColumn("positions", demand_times(*[F.col(c) for c in ("target", "source_size", "slope", "before", "size")]))
    rows = timed.select(
        "doc_id", "source", "size", "source_size", "target", (F.size("positions") * F.col("size")).cast("long").alias("taken"), "positions",
        F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0)).alias("first"),
    )
    keys = ["first", "source", "doc_id"]
    return (rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys).drop("first")


def place(scheduled: DataFrame, partitions: int | None = None) -> DataFrame:
    """The training order, one row per placed copy: `doc_id`, `source`, `size`, `copy`, `position`, range-sorted by position."""
    rows = scheduled.select("doc_id", "source", "size", F.posexplode("positions").alias("copy", "position"))
    keys = ["position", "source", "doc_id", "copy"]
    return (rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, **options) -> DataFrame:
    # the words are counted once; three steps read the sizes
    return schedule(plan_mix(cut_lineage(sizes(docs, doc_id, text, source)), seed=seed, **options))
