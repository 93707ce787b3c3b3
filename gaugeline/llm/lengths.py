"""Exact length histogram of encoded documents, and what suffix sums over it answer for every context limit.

Each task encodes its documents with a public byte-level BPE vocabulary and counts lengths; the counts of equal lengths are
added up per task before they are shuffled. Between two neighbouring lengths all answers are linear in the limit, so one
row per length answers every limit. Suffix sums run per slice of lengths after the slices' totals, never over all lengths
in one task. Null and empty texts have length 0. Repeated rows count as often as they stand. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.session import cut_lineage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SLICE = 1024


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def length_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """`n_tokens`, `n_docs`: how many documents have each encoded length."""
    pattern = pattern or _pattern()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, seen = _encoding(vocabulary, pattern), Counter()
        for batch in batches:
            for value in batch.column(0):
                seen[len(encoding.encode_ordinary(value.as_py() or ""))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "n_docs"])

    parts = docs.select(F.col(text).alias("text")).mapInArrow(count, "n_tokens long, n_docs long")
    return parts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def length_table(counts: DataFrame) -> DataFrame:
    """Per length, taken as context limit: documents and tokens at or above it, and the total when texts are cut there."""
    # two branches read the histogram; the texts are encoded once
    rows = cut_lineage(counts).withColumn("slice", F.expr(f"n_tokens div {SLICE}")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    totals = rows.groupBy("slice").agg(F.sum("n_docs").alias("slice_docs"), F.sum("tokens").alias("slice_tokens"))
    later = W.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(1, W.unboundedFollowing)
    every = W.partitionBy(F.lit(0))
    totals = totals.select(
        "slice", F.coalesce(F.sum("slice_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("slice_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("slice_docs").over(every).alias("all_docs"), F.sum("slice_tokens").over(every).alias("all_tokens"),
    )
    here = W.partitionBy("slice").orderBy("n_tokens").rowsBetween(W.currentRow, W.unboundedFollowing)
    return (
        rows.join(totals, "slice")
        .withColumn("docs_from", F.sum("n_docs").over(here) + F.col("later_docs"))
        .withColumn("tokens_from", F.sum("tokens").over(here) + F.col("later_tokens"))
        .select(
            "n_tokens", "n_docs", "docs_from", "tokens_from",
            (F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("cut_tokens"),
            # the share of documents that are no longer than this, so that quantiles read off directly
            ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("share_upto"),
            "all_docs", "all_tokens",
        )
    )


def limits_report(table: DataFrame, limits: list[int]) -> DataFrame:
    """Per context limit: `fits` (documents not longer), `cut_tokens` (total after truncation), `lost_tokens`."""
    longer = lambda n: F.coalesce(F.sum(F.when(F.col("n_tokens") > n, F.col("n_docs"))), F.lit(0))
    upto = lambda n: F.coalesce(F.sum(F.when(F.col("n_tokens") <= n, F.col("n_tokens") * F.col("n_docs"))), F.lit(0))
    total = F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0))
    rows = [F.struct(
        F.lit(n).cast("long").alias("context"), (F.coalesce(F.sum("n_docs"), F.lit(0)) - longer(n)).alias("fits"),
        (upto(n) + n * longer(n)).alias("cut_tokens"), (total - upto(n) - n * longer(n)).alias("lost_tokens"),
    ) for n in limits]
    return table.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """Per share: the smallest length that at least this share of the documents does not exceed."""
    rows = [F.struct(F.lit(float(s)).alias("share"), F.min(F.when(F.col("share_upto") >= s, F.col("n_tokens"))).alias("n_tokens")) for s in shares]
    return table.agg(F.array(*rows).alias("r")).select(F.inline("r"))
