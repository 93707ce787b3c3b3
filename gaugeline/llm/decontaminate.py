"""Benchmark decontamination with DataFrame expressions only.

A test item counts as leaked where a window of its words stands in a document. The windows of the test set form a hash
table of word blocks that is broadcast when its size, counted first, is within `broadcast_rows`, and shuffled otherwise.
Documents are scanned in aligned blocks of half a window: every occurrence of a window of n words covers a whole aligned
block of (n + 1) div 2 words, so that one look-up per block finds all places. Hits are verified word by word.

Null and empty texts have no words. Rows that share id and text are one document. A null id stays null. Items without
words take no part. Extra columns are ignored by `find_leaks` and kept by `remove_leaks`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import free_name, id_back, id_key, letter_words

WINDOW = 10
BROADCAST_ROWS = 2_000_000
_EVERY = -1  # the block number of the one entry that each document sends along, whether it has hits or not


def test_windows(items: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: `win` (its words), `n_win`, `items` (the ids that hold it, as sorted strings)."""
    words = items.select(F.col(item).cast("string").alias("item"), letter_words(F.col(text)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return (
        words.where(F.size("w") > 0)
        .select("item", "w", F.explode(starts).alias("at"))
        .groupBy(F.slice("w", F.col("at"), F.lit(window)).alias("win"))
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .withColumn("n_win", F.size("win"))
    )


def _blocks(windows: DataFrame) -> DataFrame:
    """Each block of each window: `size`, `hash`, the window, and the block's offset in it."""
    size = F.expr("(n_win + 1) div 2").cast("int")
    return windows.select("win", "items", "n_win", size.alias("size")).select(
        "win", "items", "n_win", "size", F.explode(F.sequence(F.lit(0), F.col("n_win") - F.col("size"))).alias("offset")
    ).select("win", "items", "n_win", "size", "offset", F.xxhash64("size", F.slice("win", F.col("offset") + 1, F.col("size"))).alias("hash"))


def find_leaks(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Per document: `doc_id`, `n_words`, `spans` (merged runs of hit words as [start, end)), `items`, `text_key`."""
    windows = test_windows(items, window, item, item_text)
    blocks = _blocks(windows)
    sizes = sorted(r["size"] for r in blocks.select("size").distinct().collect())  # at most (window + 1) / 2 values
    every = docs.sparkSession.range(1).select(
        F.array().cast("array<string>").alias("win"), F.array().cast("array<string>").alias("items"), F.lit(0).alias("n_win"),
        F.lit(0).alias("size"), F.lit(0).alias("offset"), F.lit(0).cast("long").alias("hash"),
    )
    lookup = blocks.unionByName(every)
    if blocks.count() <= broadcast_rows:
        lookup = F.broadcast(lookup)

    def scan(size: int):
        numbers = F.when(F.size("w") >= size, F.sequence(F.lit(0), F.expr(f"size(w) div {size}").cast("int") - 1))
        return F.transform(
            F.coalesce(numbers, F.array().cast("array<int>")),
            lambda k: F.struct(
                (k * size).alias("at"), F.lit(size).alias("size"),
                F.xxhash64(F.lit(size), F.slice("w", k * size + 1, F.lit(size))).alias("hash"),
            ),
        )

    mark = F.array(F.struct(F.lit(_EVERY).alias("at"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("hash")))
    rows = (
        docs.select(id_key(doc_id).alias("id"), F.col(text).alias("text"))
        .select("id", F.xxhash64("text").alias("text_key"), letter_words(F.col("text")).alias("w"))
        .select("id", "text_key", "w", F.explode_outer(F.concat(mark, *[scan(s) for s in sizes])).alias("block"))
        .select("id", "text_key", F.size("w").alias("n_words"), "w", "block.at", "block.size", "block.hash")
    )
    # The words around a block are cut out after the look-up, for the few blocks that are found.
    found = rows.join(lookup, ["size", "hash"]).select(
        "id", "text_key", "n_words", "items", (F.col("at") - F.col("offset")).alias("start"), "n_win",
        F.when(F.col("at") == _EVERY, F.lit(True)).when(F.col("at") < F.col("offset"), F.lit(False)).otherwise(
            F.slice("w", F.greatest(F.col("at") - F.col("offset"), F.lit(0)) + 1, F.greatest("n_win", F.lit(1))) == F.col("win")
        ).alias("same"),
    )
    hit = F.when(F.col("n_win") > 0, F.struct("start", (F.col("start") + F.col("n_win")).alias("end")))
    merged = F.aggregate(
        "hits", F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(-1)) >= x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.try_element_at(acc, F.lit(-1))["start"].alias("start"),
                F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end"),
            ))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return (
        found.where("same").groupBy("id", "text_key", "n_words")
        .agg(F.array_sort(F.collect_set(hit)).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .select(id_back("id").alias("doc_id"), "n_words", merged.alias("spans"), "items", "text_key")
    )


def remove_leaks(docs: DataFrame, items: DataFrame, how: str = "documents", doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Drops documents with a hit (`documents`), or cuts the hit words out of their texts (`spans`).

    Texts without a hit stay as they are. A cut text is the rest of its words, as they were written, between single spaces.
    """
    leaks = find_leaks(docs, items, doc_id=doc_id, text=text, **options).where(F.size("spans") > 0)
    leak_id, leak_key, leak_spans = (free_name(docs.columns, n) for n in ("leak_id", "leak_key", "leak_spans"))
    mine, leaks = docs.alias("doc"), leaks.select(id_key("doc_id").alias(leak_id), F.col("text_key").alias(leak_key), F.col("spans").alias(leak_spans))
    same = (id_key(f"doc.{doc_id}") == F.col(leak_id)) & (F.xxhash64(F.col(f"doc.{text}")) == F.col(leak_key))
    if how == "documents":
        return mine.join(leaks, same, "left_anti")
    if how != "spans":
        raise ValueError("how is documents or spans")
    words = F.array_remove(F.split(F.col(f"doc.{text}"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")
    rest = F.filter(words, lambda _, i: ~F.exists(leak_spans, lambda s: (i >= s["start"]) & (i < s["end"])))
    cut = F.when(F.col(leak_spans).isNull(), F.col(f"doc.{text}")).otherwise(F.array_join(rest, " ")).alias(text)
    return mine.join(leaks, same, "left").select(*[cut if c == text else F.col(f"doc.`{c}`") for c in docs.columns])
