"""Near-duplicate documents: HyperMinHash registers, banding, and verification on full shingle sets.

A document's set holds the hashes of its distinct shingles of `width` words. A shingle's hash picks one of 256 buckets; a
bucket's register keeps the smallest remaining hash as its count of leading zeros plus ten mantissa bits; for the bands,
empty registers take over filled ones. Bands of compressed registers give candidates; documents that share a band are tied to the band's smallest id, and the connected candidates form
groups. Each group is dealt in chunks of bounded bytes, and each pair of chunks goes to one task with the whole texts. There,
pairs whose collision-corrected Jaccard estimate lies far below the limit are left out, pairs that are linked already need no
look, and all others are verified on the full sets. The links found join the chunks' components.

Documents with equal sets are one before the banding, so exact copies cost nothing however many there are. Null, empty and
blank texts have an empty set and are linked with nothing. A text with fewer words than a shingle is one shingle. Rows that
share an id count as one document, linked with whatever one of them is linked with. A null id sorts first and stays null.
Extra columns do not matter. An empty table gives no rows.

Two sets of similarity s agree in a band of 6 registers with probability s**6; at 0.85 all 42 bands miss with 2e-9, at 0.8
with 3e-6. The limit is an argument, a fraction of two whole numbers. A pair at the limit is left out by its estimate only beyond
six standard deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.arrowtext import LOWER, texts
from gaugeline.llm.common import free_name, id_back, id_key
from gaugeline.llm.components import components
from gaugeline.session import cut_lineage

SHINGLE, LIMIT = 5, (85, 100)
BUCKETS, MANTISSA, BAND = 256, 10, 6
CHUNK_BYTES = 8 << 20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_POWERS = np.ones(1, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[1]
    h = (h ^ (h >> np.uint64(29))) * _ODD[2]
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.full(max(n, 1 << 17), _ODD[0])
        _POWERS[0] = 1
        np.cumprod(_POWERS, out=_POWERS)
    return _POWERS


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODES = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD[3])


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash per word, in order: each word's codes against powers that count from the word's start."""
    data = np.frombuffer(text.translate(LOWER), np.uint8)
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.arange(len(data)) - np.repeat(starts, np.diff(np.concatenate([[0], starts[1:], [len(data)]])))
    values = np.where(inside[1:-1], _CODES[data] * _powers(len(data) + 1)[np.maximum(at, 0)], np.uint64(0))
    return _mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64) * _ODD[4])


def shingle_set(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    total = np.full(n, min(len(words), width), np.uint64) * _ODD[5]
    for k in range(min(width, len(words))):
        total = _mix(total * _ODD[0] + words[k:k + n])
    return np.unique(total)


def registers(hashes: np.ndarray) -> np.ndarray:
    """uint16 per bucket: leading zeros (6 bits) and mantissa of the smallest rest; 65535 for an empty bucket."""
    rest = np.full(BUCKETS, np.uint64(2**64 - 1))
    np.minimum.at(rest, (hashes & np.uint64(BUCKETS - 1)).astype(np.intp), hashes >> np.uint64(8))
    full = rest != np.uint64(2**64 - 1)
    value = np.maximum(rest, np.uint64(1))
    top = np.frexp(value.astype(np.float64))[1]  # bits in use, of 56
    top = np.where((value >> (top - 1).astype(np.uint64)) == 0, top - 1, top)  # rounding up to the next power
    zeros = 56 - top
    shift = (top - 1 - MANTISSA)
    mantissa = np.where(shift >= 0, value >> np.maximum(shift, 0).astype(np.uint64), value << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64(2**MANTISSA - 1)
    return np.where(full, (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | mantissa, np.uint64(65535)).astype(np.uint16)


_PROBES = np.argsort(np.random.default_rng(1).random((BUCKETS, BUCKETS)), axis=1)


def dense(regs: np.ndarray) -> np.ndarray:
    """Every empty register takes over the first filled one in a fixed random order of its own.

    So a band of a short text holds as many registers as that of a long one, and two sets agree in a register with the
    probability of their similarity whatever their sizes are.
    """
    out = regs.copy()
    for i in np.flatnonzero((regs == 65535).any(1)):
        filled = regs[i] != 65535
        empty = np.flatnonzero(~filled)
        out[i, empty] = regs[i, _PROBES[empty, filled[_PROBES[empty]].argmax(1)]]
    return out


def band_keys(regs: np.ndarray, band: int = BAND) -> np.ndarray:
    """A 64-bit key per band of dense registers, one row per row of registers; the band's number is part of the key."""
    n = BUCKETS // band
    rows = dense(regs)[:, :n * band].reshape(len(regs), n, band).astype(np.uint64)
    keys = np.tile(np.arange(n, dtype=np.uint64) * _ODD[2] + _ODD[3], (len(regs), 1))
    for k in range(band):
        keys = _mix(keys * _ODD[0] + rows[:, :, k])
    return keys


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, limit: tuple[int, int] = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of registers `a` (one row) against rows of `b`, and their standard deviations at the limit.

    Of the buckets filled on either side, those that agree count, less what agrees by chance: registers of independent sets
    of n and m shingles agree with about 0.7213 * 2**-MANTISSA * n * m / (n + m)**2, as a register's cell at height x is on
    average 0.7213 * 2**-MANTISSA * x wide.
    """
    filled = (a != 65535) | (b != 65535)
    used = np.maximum(1, filled.sum(1))
    agree = ((a == b) & filled).sum(1) / used
    chance = 0.7213 * 2.0**-MANTISSA * n_a * n_b / (n_a + n_b) ** 2
    share = limit[0] / limit[1]
    return np.clip((agree - chance) / (1 - chance), 0, 1), np.sqrt(share * (1 - share) / used)


SIGNATURE = "id long, n_shingles long, set_a long, set_b long, bands array<long>, n_bytes long"


def signatures(docs: DataFrame, width: int = SHINGLE, band: int = BAND, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its set's size, a 128-bit mark of the set, and the band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks, regs, n_bytes = [], [], [], []
            for value in texts(batch.column(1)):
                own = shingle_set(value, width)
                sizes.append(len(own))
                n_bytes.append(len(value))
                with np.errstate(over="ignore"):
                    marks.append((int(own.sum()), int(_mix(own * _ODD[5]).sum())) if len(own) else (0, 0))
                if len(own):
                    regs.append(registers(own))
            mark = np.array(marks, np.uint64).reshape(-1, 2).view(np.int64)
            keys = band_keys(np.array(regs, np.uint16).reshape(-1, BUCKETS), band)
            offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) > 0) * keys.shape[1]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(mark[:, 0]), pa.array(mark[:, 1]),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel())), pa.array(n_bytes, pa.int64()),
            ], ["id", "n_shingles", "set_a", "set_b", "bands", "n_bytes"])

    return docs.select(id_key(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(sign, SIGNATURE)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


def linked(a: np.ndarray, b: np.ndarray, limit: tuple[int, int] = LIMIT) -> bool:
    """Whether two sorted sets reach the limit."""
    if min(len(a), len(b)) * limit[1] < max(len(a), len(b)) * limit[0]:
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return limit[1] * same >= limit[0] * (len(both) - same)


def link_sets(sets: list[np.ndarray], sides: np.ndarray, limit: tuple[int, int] = LIMIT) -> list[tuple[int, int]]:
    """Links that connect what the limit connects. With two sides, pairs of one side are another task's work."""
    regs = np.stack([registers(s) for s in sets])
    sizes = np.array([len(s) for s in sets], np.int64)
    forest, links, two = Forest(len(sets)), [], len(set(sides.tolist())) > 1
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    for place, i in enumerate(order):
        i = int(i)
        later = order[place + 1:]
        last = np.searchsorted(sizes[later] * limit[0], sizes[i] * limit[1], side="right")
        later = later[:last]
        if two:
            later = later[sides[later] != sides[i]]
        roots = forest.roots()
        later = later[roots[later] != roots[i]]
        if not len(later):
            continue
        guess, spread = similarity(regs[i], regs[later], sizes[i], sizes[later], limit)
        near = later[guess >= limit[0] / limit[1] - 6 * spread]
        for j in near[np.argsort(-guess[guess >= limit[0] / limit[1] - 6 * spread], kind="stable")].tolist():
            a, b = forest.root(i), forest.root(j)
            if a != b and linked(sets[i], sets[j], limit):
                forest.up[max(a, b)] = min(a, b)
                links.append((i, j))
    return links


def near_duplicates(
    docs: DataFrame, width: int = SHINGLE, band: int = BAND, chunk_bytes: int = CHUNK_BYTES, doc_id: str = "doc_id", text: str = "text", limit: tuple[int, int] = LIMIT,
) -> DataFrame:
    """Per row: `doc_id`, `n_shingles`, `component_id` (smallest id reachable), `kept` (whether that is its own)."""
    signed = cut_lineage(signatures(docs, width, band, doc_id, text))
    filled = signed.where("n_shingles > 0")
    # one node per set; rows that share an id tie the sets they have
    copies = filled.groupBy("n_shingles", "set_a", "set_b").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    same_set = ["n_shingles", "set_a", "set_b"]
    tied = filled.join(copies.where("n > 1"), same_set).where("id <> node").select("id", "node", *same_set)
    nodes = filled.join(tied.select("id", *same_set), ["id", *same_set], "left_anti")

    keys = nodes.select("id", F.explode("bands").alias("key"))
    first = keys.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
    drawn = keys.join(first, "key").where("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v"))
    grouped = components(drawn)
    members = grouped.union(grouped.select(F.col("component").alias("node"), "component").distinct()).select(F.col("node").alias("id"), F.col("component").alias("grp"))
    sized = members.join(nodes.groupBy("id").agg(F.max("n_bytes").alias("n_bytes")), "id")
    chunks = sized.groupBy("grp").agg(F.greatest(F.lit(1), F.ceil(F.sum("n_bytes") / F.lit(float(chunk_bytes)))).cast("int").alias("chunks"))
    dealt = cut_lineage(
        sized.join(chunks, "grp").select("id", "grp", "chunks", "n_bytes", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"))
    )
    small = dealt.agg(F.coalesce(F.sum(F.when(F.col("chunks") == 1, F.col("n_bytes"))), F.lit(0))).first()[0]
    bins = max(1, -(-small // chunk_bytes))
    # a task has one pair of chunks of one large group, or a bin of small groups as a whole
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.col("grp").alias("large"), F.least("chunk", c).alias("lo"), F.greatest("chunk", c).alias("hi")),
    )
    shared = F.array(F.struct(F.lit(None).cast("long").alias("large"), F.pmod(F.xxhash64("grp"), F.lit(bins)).cast("int").alias("lo"), F.lit(-1).alias("hi")))
    wanted = dealt.select("id", "grp", "chunk", F.explode(F.when(F.col("chunks") == 1, shared).otherwise(pairs)).alias("p")).select("id", "grp", "chunk", "p.*")
    rows = docs.select(id_key(doc_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(wanted, "id")

    def verify(key: tuple, task: pd.DataFrame) -> pd.DataFrame:
        u, v = [], []
        for _, group in task.groupby("grp"):
            ids = group["id"].to_numpy()
            links = link_sets([shingle_set(t.encode(), width) for t in group["text"]], group["chunk"].to_numpy(), limit)
            u += [ids[i] for i, _ in links]
            v += [ids[j] for _, j in links]
        return pd.DataFrame({"u": u, "v": v}, dtype="int64")

    verified = rows.groupBy("large", "lo", "hi").applyInPandas(verify, "u long, v long")
    found = components(tied.select(F.col("id").alias("u"), F.col("node").alias("v")).union(verified))
    return (
        signed.select("id", "n_shingles").join(found, F.col("id") == F.col("node"), "left")
        .select("id", "n_shingles", F.coalesce("component", "id").alias("component"))
        .select(id_back("id").alias("doc_id"), "n_shingles", id_back("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` without those whose component holds a smaller id. Rows that share an id stay or go together."""
    gone_id = free_name(docs.columns, "gone_id")
    gone = near_duplicates(docs, doc_id=doc_id, **options).where(~F.col("kept")).select(id_key("doc_id").alias(gone_id)).distinct()
    return docs.alias("doc").join(gone, id_key(f"doc.`{doc_id}`") == F.col(gone_id), "left_anti")
