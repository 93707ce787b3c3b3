"""Ranked lexical search turned round: the items' terms are the index, and documents stream through it.

The items are dealt into blocks of a bounded number of words. A block's terms, with the items that hold them, are an inverted
index that every task gets. Documents become counts of the block's terms once; from those come how many documents hold a term,
and then each task streams its counts through the index and updates one heap of the `best` highest scores per item, so a task
returns that many rows per item at most. The heaps are merged in two steps, so that no task merges those of all tasks.

Scores are whole numbers: with N documents that have terms, L terms in all, n in one document, df documents that hold a term and
tf its occurrences, a term's weight is w = floor(1000 ln((2N + 2) / (2df + 1))), a document's m = 75 + (25 n N) div L, and the score
is the sum of w ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, repeats included.

Null and empty texts have no terms and are not counted in N. Every row of documents is a document of its own and every row of
items an item of its own, even if ids repeat; null ids stay null, a null document id comes before all others on equal scores.
Items without terms, or whose terms are in no document, return nothing. Texts are cut at word ends and read in pieces, so a very
long one needs memory for its distinct index terms only; an item longer than a block has a block of its own. Extra columns do
not matter; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.arrowtext import LETTER_WORDS, texts
from gaugeline.llm.common import id_back, id_key, letter_words
from gaugeline.session import cut_lineage

BEST = 20
#: Words of items per block, which bounds what is broadcast; an item is never split.
BLOCK_WORDS = 1 << 20
PIECE = 1 << 20
#: Cells of the score table of a task, items times documents of a step.
CELLS = 1 << 21
MERGES = 64


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        part = text[at:end].translate(LETTER_WORDS)
        # a word that goes on beyond the piece is read to its end
        while end < len(text) and not part.endswith(b" "):
            more = text[end:end + 64].translate(LETTER_WORDS)
            stop = more.find(b" ")
            part += more if stop < 0 else more[:stop + 1]
            end += len(more) if stop < 0 else stop + 1
        yield part.split()
        at = end


class Index:
    """Items of a block and, per term, the items that hold it with their repeats."""

    def __init__(self, rows: list[tuple[int, object, str, int]], kind: str = "long"):
        self.kind = kind
        self.items = sorted({(r, i) for r, i, _, _ in rows}, key=lambda x: x[0])
        number = {r: k for k, (r, _) in enumerate(self.items)}
        self.terms: dict[bytes, int] = {}
        held: list[list[tuple[int, int]]] = []
        for row, _, term, repeats in rows:
            place = self.terms.setdefault(term.encode(), len(self.terms))
            if place == len(held):
                held.append([])
            held[place].append((number[row], repeats))
        self.starts = np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int64)
        flat = np.array([p for h in held for p in h], np.int64).reshape(-1, 2)
        self.holders, self.repeats = flat[:, 0], flat[:, 1]


COUNTS = "id long, n long, terms array<int>, tfs array<int>"


def term_counts(docs: DataFrame, index: Index, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: `id`, `n` (its terms with repeats), and how often each term of the index occurs."""
    known = docs.sparkSession.sparkContext.broadcast(index.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = known.value
        for batch in batches:
            sizes, ends, terms, tfs = [], [0], [], []
            for value in texts(batch.column(1)):
                n, found = 0, Counter()
                for words in pieces(value):
                    n += len(words)
                    for word, times in Counter(words).items():
                        if word in place:
                            found[place[word]] += times
                sizes.append(n)
                terms += found.keys()
                tfs += found.values()
                ends.append(len(terms))
            cut = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(cut, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(tfs, pa.int32())),
            ], ["id", "n", "terms", "tfs"])

    return docs.select(id_key(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(count, COUNTS)


class Heaps:
    """The `best` highest scores of each item, ties to the smaller id."""

    def __init__(self, items: int, best: int):
        self.best = best
        self.scores, self.ids = np.zeros((items, best), np.int64), np.full((items, best), np.iinfo(np.int64).max)

    def update(self, table: np.ndarray, ids: np.ndarray) -> None:
        """`table` has a row per document and a column per item."""
        doc, item = np.nonzero((table > 0) & (table >= self.scores[:, -1]))
        if not len(doc):
            return
        hit = np.unique(item)
        owner = np.concatenate([item, np.repeat(hit, self.best)])
        score = np.concatenate([table[doc, item], self.scores[hit].ravel()])
        name = np.concatenate([ids[doc], self.ids[hit].ravel()])
        order = np.lexsort((name, -score, owner))
        owner = owner[order]
        first = np.searchsorted(owner, hit)
        kept = order[(first[:, None] + np.arange(self.best)).ravel()]
        self.scores[hit], self.ids[hit] = score[kept].reshape(-1, self.best), name[kept].reshape(-1, self.best)


def best_documents(counts: DataFrame, index: Index, weights: np.ndarray, documents: int, words: int, best: int) -> DataFrame:
    """Heaps of every task: `item` (its number in the block), `id`, `score`."""
    sent = counts.sparkSession.sparkContext.broadcast((index.starts, index.holders, index.repeats, weights))
    n_items = len(index.items)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, holders, repeats, weight = sent.value
        heaps = Heaps(n_items, best)
        step = max(1, CELLS // n_items)
        for batch in batches:
            ids, n = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            # Python's whole numbers: 25 n N may go beyond 64 bits
            m = np.array([75 + (25 * int(x) * documents) // max(1, words) for x in n], np.int64)
            lists, times = batch.column(2), batch.column(3)
            ends = lists.offsets.to_numpy()
            terms, tfs = lists.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            ends = ends - ends[0]
            for low in range(0, len(ids), step):
                high = min(len(ids), low + step)
                term, tf = terms[ends[low]:ends[high]], tfs[ends[low]:ends[high]]
                doc = np.repeat(np.arange(high - low), np.diff(ends[low:high + 1]))
                part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[low:high][doc]))
                table = np.zeros((high - low) * n_items, np.int64)
                widths = starts[term + 1] - starts[term]
                cut = np.concatenate([[0], np.cumsum(widths)])
                # postings are spelled out for some terms at a time
                at = 0
                while at < len(term):
                    end = max(at + 1, int(np.searchsorted(cut, cut[at] + CELLS, side="right")) - 1)
                    width = widths[at:end]
                    posting = np.arange(cut[end] - cut[at]) - np.repeat(cut[at:end] - cut[at], width) + np.repeat(starts[term[at:end]], width)
                    np.add.at(table, np.repeat(doc[at:end], width) * n_items + holders[posting], np.repeat(part[at:end], width) * repeats[posting])
                    at = end
                heaps.update(table.reshape(-1, n_items), ids[low:high])
        item, place = np.nonzero(heaps.scores)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array(heaps.ids[item, place]), pa.array(heaps.scores[item, place])], ["item", "id", "score"]
        )

    return counts.mapInArrow(score, "item int, id long, score long")


def ranked(rows: DataFrame, keys: list[str], best: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def search_block(docs: DataFrame, index: Index, best: int, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    counts = cut_lineage(term_counts(docs, index, doc_id, text))
    documents, words = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(index.terms), np.int64)
    for term, df in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row per term of the block
        holding[term] = df
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in holding], np.int64)
    found = best_documents(counts, index, weights, documents, words, best)
    some = ranked(found.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(MERGES))), ["item", "part"], best).drop("rank", "part")
    names = spark.createDataFrame([(k, i) for k, (_, i) in enumerate(index.items)], f"item int, item_id {index.kind}")
    return ranked(some, ["item"], best).join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), id_back("id").alias("doc_id"), "score")


def search(
    docs: DataFrame, items: DataFrame, best: int = BEST, block_words: int = BLOCK_WORDS, doc_id: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Per item and rank: `item_id`, `rank` (from 1), `doc_id`, `score`."""
    asked = cut_lineage(
        items.select(F.col(item).alias("item_id"), F.monotonically_increasing_id().alias("row"), letter_words(F.col(item_text)).alias("words"))
        .where(F.size("words") > 0)
    )
    kind = asked.schema["item_id"].dataType.simpleString()
    total = asked.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_words))
    found = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block)
        rows = part.select("row", "item_id", F.explode("words").alias("term")).groupBy("row", "item_id", "term").count().collect()
        if rows:  # about `block_words` at most
            index = Index(sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[2])), kind)
            found = found.unionByName(search_block(docs, index, best, doc_id, text))
    return found
