"""Removal of repeated passages by a sparse suffix array over bytes.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id, judged on the input.

Suffixes: of all suffixes only anchors are kept, the places where a gram of 16 bytes has the smallest hash among the grams of
some string of `length` bytes. Equal strings have equal anchors, so every repeated string is seen from an anchor inside it.
A first exchange of gram hashes finds the grams that stand in two documents; only their suffixes go on.

Sorting: splitters sampled from the leading eight bytes of suffixes range-partition them. Each range sorts its suffixes by
multikey quicksort, eight bytes a key, and takes the common prefixes of neighbours. For every offset of a string around its
anchor, suffixes that agree to the right and, by a hash of what stands before them, to the left, hold the same string; all
but those of the smallest id are repeats. Equal leading bytes never lie in two ranges, so no run crosses a boundary.

Documents live in chunks of bounded bytes, by a hash of the id; everything between chunks and ranges is packed into binary
values. Exact copies are found by their SHA-256 first, are repeats as a whole, and send no suffixes. Null texts are empty;
texts under `length` bytes stay whole. Rows that share an id do not repeat each other, and
each is judged by its own text: copies and spans belong to an id and the SHA-256 of a text. A null id is smaller than any other.
An empty table gives no rows. Other columns are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.arrowtext import texts
from gaugeline.llm.common import id_key
from gaugeline.session import cut_lineage

LENGTH, GRAM = 50, 16
CHUNK_BYTES, LEAST_CHUNKS = 8 << 20, 32
SAMPLE_DOCS, SAMPLE_KEYS = 2000, 40_000
PIECE = 1 << 20  # bytes of a text that are looked at together
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M[1]
    h = (h ^ (h >> np.uint64(29))) * _M[2]
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every gram: hashes of single bytes are joined to hashes of 2, 4, 8 ... bytes."""
    level, size, done, at = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while size <= gram:
        if gram & size:  # the gram's length as a sum of powers of two
            part = level[at:]
            done, at = (part if done is None else done[:len(part)] * _M[2] + part), at + size
        if size * 2 <= gram:
            level = level[:-size] * _M[0] + _mix(level[size:]) if size > 1 else level[:-1] * _M[0] + level[1:]
        size *= 2
    return _mix(done[:len(data) - gram + 1])


def _slide(values: np.ndarray, width: int, join) -> np.ndarray:
    out, size = values, 1
    while size * 2 <= width:
        out = join(out[:-size], out[size:])
        size *= 2
    n = len(values) - width + 1
    return join(out[:n], out[width - size:width - size + n]) if size < width else out


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are the smallest of some string of `length` bytes."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width, n = length - gram + 1, len(data) - gram + 1
    places, hashes = [], []
    for begin in range(0, n, PIECE):
        lo, hi = max(0, begin - width + 1), min(n, begin + PIECE + width - 1)
        h = gram_hashes(data[lo:hi + gram - 1], gram)
        if len(h) < width:  # the last grams of a text whose last piece is short
            lo = max(0, n - width)
            h = gram_hashes(data[lo:], gram)
            hi = n
        least = _slide(h, width, np.minimum)
        pad = np.zeros(width - 1, np.uint64)
        most = _slide(np.concatenate([pad, least, pad]), width, np.maximum)
        at = np.flatnonzero(most == h)
        at = at[(at + lo >= begin) & (at + lo < begin + PIECE)]
        places.append(at + lo)
        hashes.append(h[at])
    return np.concatenate(places), np.concatenate(hashes)


def multikey_order(keys: np.ndarray) -> np.ndarray:
    """Order of rows of big-endian words: rows are sorted by one word, then equal runs alone by the next."""
    order = np.argsort(keys[:, 0], kind="stable")
    if not len(order):
        return order
    group = np.concatenate([[0], np.cumsum(np.diff(keys[order, 0]) != 0)])
    for word in range(1, keys.shape[1]):
        same = np.zeros(len(order), bool)
        equal = group[1:] == group[:-1]
        same[1:] |= equal
        same[:-1] |= equal
        open_ = np.flatnonzero(same)
        if not len(open_):
            break
        values = keys[order[open_], word]
        inner = np.lexsort((values, group[open_]))
        order[open_] = order[open_][inner]
        changed = np.zeros(len(order), bool)
        changed[1:] = group[1:] != group[:-1]
        inside = np.zeros(len(open_), bool)
        inside[1:] = values[inner][1:] != values[inner][:-1]
        changed[open_] |= inside
        group = np.cumsum(changed)
    return order


def repeated_spans(context: np.ndarray, ids: np.ndarray, places: np.ndarray, right: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records of suffixes with `length - gram` bytes before and `length` bytes from the anchor: which are repeats, from, to."""
    before = length - gram
    n = len(ids)
    words = np.zeros((n, -(-length // 8) * 8), np.uint8)
    words[:, :length] = context[:, before:]
    order = multikey_order(words.view(">u8").astype(np.uint64))
    context, ids, places, right = context[order], ids[order], places[order], right[order]
    differ = context[1:, before:] != context[:-1, before:]
    common = np.where(differ.any(1), differ.argmax(1), length) if n > 1 else np.zeros(0, int)
    low, high = np.full(n, -1), np.full(n, -1)
    left = np.zeros(n, np.uint64)
    for j in range(before + 1):
        if j:
            left = left * _M[0] + context[:, before - j].astype(np.uint64) + np.uint64(1)
        reach = common >= length - j
        run = np.concatenate([[0], np.cumsum(~reach)])
        near = np.zeros(n, bool)
        near[1:] |= reach
        near[:-1] |= reach
        use = np.flatnonzero(near & (places >= j) & (right >= length - j))
        if len(use) < 2:
            continue
        key = _mix(_mix(left[use]) + run[use].astype(np.uint64) * _M[2])
        by = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
        least = np.repeat(np.minimum.reduceat(ids[use][by], starts), np.diff(np.concatenate([starts, [len(by)]])))
        hit = use[by[ids[use][by] > least]]
        low[hit] = np.where(low[hit] < 0, j, low[hit])
        high[hit] = j
    found = np.flatnonzero(high >= 0)
    return order[found], places[found] - high[found], places[found] - low[found] + length


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[first], ends[np.concatenate([first[1:], [True]])]


def cut_text(data: bytes, starts: np.ndarray, ends: np.ndarray, whole_characters: bool) -> bytes:
    """What is left; with `whole_characters` a character goes only if all its bytes do."""
    kept, at = [], 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        if whole_characters:
            while s < e and data[s] & 0xC0 == 0x80:
                s += 1
            while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
                e -= 1
        kept.append(data[at:s])
        at = max(at, e)
    return b"".join([*kept, data[at:]])


def _view(value, kind) -> np.ndarray:
    return np.frombuffer(value.as_py(), kind)


def _pack(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, as_text: bool = True, seed: int = 3,
) -> DataFrame:
    """All columns of `docs`, with the text cut to whole characters, or with `as_text` off the rest as bytes, and besides
    `n_bytes`, `removed` array<struct<start, end>> (maximal runs of removed bytes), which take the place of columns so named."""
    before, spark = length - gram, docs.sparkSession
    columns = [c for c in docs.columns if c not in ("n_bytes", "removed")]
    marks = cut_lineage(docs.select(id_key(doc_id).alias("id"), F.sha2(F.col(text).cast("binary"), 256).alias("mark"), F.octet_length(text).alias("n")))
    total, rows = marks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_chunks = max(LEAST_CHUNKS, -(-total // chunk_bytes))
    chunk_of = lambda column: F.pmod(F.xxhash64(column), F.lit(n_chunks)).cast("int")
    long_ones = marks.where(F.col("n") >= length)
    first = long_ones.groupBy("mark").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    copies = long_ones.join(first, "mark").where("id > first").select(chunk_of("id").alias("chunk"), "id", F.lit(None).cast("binary").alias("a"), F.unhex("mark").alias("b"), F.lit(None).cast("binary").alias("c"))
    copies = cut_lineage(copies)
    own = docs.select(id_key(doc_id).alias("_suffix_id"), chunk_of(id_key(doc_id)).alias("_suffix_chunk"), F.col(text).alias("_suffix_text"), *[F.col(f"`{c}`").alias(f"_column_{i}") for i, c in enumerate(columns) if c != text])
    chunks = own.groupBy("_suffix_chunk")

    def copied(side: pa.Table) -> set[tuple[int, bytes]]:
        found = side.filter(pc.is_null(side["a"]))
        return set(zip(found["id"].to_pylist(), found["b"].to_pylist()))

    def numbered(docs_of: pa.Table) -> tuple[list[tuple[int, bytes] | None], dict[tuple[int, bytes], int]]:
        """Per row its id and the mark of its text, nothing for a short one; and the place of each in their order."""
        marked = zip(docs_of["_suffix_id"].to_pylist(), texts(docs_of["_suffix_text"]))
        keys = [(name, hashlib.sha256(value).digest()) if len(value) >= length else None for name, value in marked]
        return keys, {key: n for n, key in enumerate(sorted(set(keys) - {None}))}

    def originals(docs_of: pa.Table, side: pa.Table):
        skip, (keys, numbers) = copied(side), numbered(docs_of)
        for key, value in zip(keys, texts(docs_of["_suffix_text"])):
            if key is not None and key not in skip:
                yield key[0], numbers[key], np.frombuffer(value, np.uint8)

    def gather(key: tuple, docs_of: pa.Table, side: pa.Table) -> pa.Table:
        """Distinct gram hashes of a chunk, dealt to buckets; the lowest bit tells if two of its documents have it."""
        grams, owner = [], []
        for name, _, data in originals(docs_of, side):
            grams.append(np.unique(anchors(data, length, gram)[1]))
            owner.append(np.full(len(grams[-1]), name))
        out = []
        if grams:
            grams, owner = np.concatenate(grams) & ~np.uint64(1), np.concatenate(owner)
            order = np.lexsort((owner, grams))
            grams, owner = grams[order], owner[order]
            starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            ends = np.concatenate([starts[1:], [len(grams)]]) - 1
            values = grams[starts] | (owner[starts] != owner[ends]).astype(np.uint64)
            bucket = _mix(values >> np.uint64(1)) % np.uint64(n_chunks)
            order = np.argsort(bucket, kind="stable")
            values, bucket = values[order], bucket[order]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            out = [(int(bucket[s]), key[0].as_py(), values[s:e].tobytes()) for s, e in zip(at, np.concatenate([at[1:], [len(values)]]))]
        return _pack(out, ["bucket", "chunk", "a"], [pa.int32(), pa.int32(), pa.binary()])

    gathered = chunks.cogroup(copies.groupBy("chunk")).applyInArrow(gather, "bucket int, chunk int, a binary")

    def shared(table: pa.Table) -> pa.Table:
        """Per chunk the grams of a bucket that stand in two documents."""
        names, parts = table["chunk"].to_pylist(), [_view(v, np.uint64) for v in table["a"]]
        grams = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        plain = grams >> np.uint64(1)
        order = np.argsort(plain, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], plain[order][1:] != plain[order][:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(plain)]]))
        many = np.repeat((sizes > 1) | (np.maximum.reduceat(grams[order] & np.uint64(1), starts) > 0), sizes)
        keep = np.sort(order[many])
        at = np.searchsorted(owner[keep], np.arange(len(parts) + 1))
        out = [(names[i], None, (grams[keep[at[i]:at[i + 1]]] >> np.uint64(1)).tobytes(), None, None) for i in range(len(parts)) if at[i] < at[i + 1]]
        return _pack(out, ["chunk", "id", "a", "b", "c"], [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])

    side_schema = "chunk int, id long, a binary, b binary, c binary"
    wanted = gathered.groupBy("bucket").applyInArrow(shared, side_schema)

    def sample(batches):
        for batch in batches:
            keys = []
            for value in texts(batch.column(0)):
                data = np.frombuffer(value, np.uint8)
                at = anchors(data, length, gram)[0]
                keys += [int.from_bytes(value[i:i + 8], "big") - 2**63 for i in at[:: max(1, len(at) // (SAMPLE_KEYS // SAMPLE_DOCS))].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], ["key"])

    drawn = docs.select(text).sample(min(1.0, SAMPLE_DOCS / max(1, rows)), seed).mapInArrow(sample, "key long")
    keys = np.sort(np.array([r[0] for r in drawn.collect()], np.int64))  # about SAMPLE_KEYS numbers at every size of input
    n_ranges = int(n_chunks)
    splitters = np.unique(keys[np.linspace(0, len(keys) - 1, n_ranges + 1).astype(int)[1:-1]]) if len(keys) else keys

    head_kind = np.dtype([("id", np.int64), ("place", np.int64), ("right", np.int32), ("row", np.int32)])

    def send(key: tuple, docs_of: pa.Table, side: pa.Table) -> pa.Table:
        """Suffixes whose gram is shared, with what stands around them, dealt to ranges by their leading bytes."""
        blobs = [_view(v, np.uint64) for v in side["a"] if v.is_valid]
        if not blobs:
            return _pack([], ["part", "chunk", "n", "a", "b"], [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])
        grams = np.sort(np.concatenate(blobs))
        contexts, heads = [], []
        for name, row, data in originals(docs_of, side):
            at, hashes = anchors(data, length, gram)
            plain = hashes >> np.uint64(1)
            at = at[grams[np.minimum(np.searchsorted(grams, plain), len(grams) - 1)] == plain]
            if len(at):
                padded = np.concatenate([np.zeros(before, np.uint8), data, np.zeros(length, np.uint8)])
                contexts.append(padded[at[:, None] + np.arange(before + length)])
                head = np.zeros(len(at), head_kind)
                head["id"], head["place"], head["right"], head["row"] = name, at, np.minimum(length, len(data) - at), row
                heads.append(head)
        if not contexts:
            return _pack([], ["part", "chunk", "n", "a", "b"], [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])
        context, head = np.concatenate(contexts), np.concatenate(heads)
        lead = np.ascontiguousarray(context[:, before:before + 8]).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)
        part = np.searchsorted(splitters, lead.view(np.int64), side="right")
        order = np.lexsort((lead, part))
        context, head, part = context[order], head[order], part[order]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        codec = pa.Codec("zstd", 1)
        out = [
            (int(part[s]), key[0].as_py(), int(e - s), codec.compress(context[s:e].tobytes(), asbytes=True), codec.compress(head[s:e].tobytes(), asbytes=True))
            for s, e in zip(starts, np.concatenate([starts[1:], [len(part)]]))
        ]
        return _pack(out, ["part", "chunk", "n", "a", "b"], [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    sides = wanted.unionByName(copies)
    sent = chunks.cogroup(sides.groupBy("chunk")).applyInArrow(send, "part int, chunk int, n int, a binary, b binary")

    def compare(table: pa.Table) -> pa.Table:
        codec, contexts, heads = pa.Codec("zstd"), [], []
        for n, a, b in zip(table["n"].to_pylist(), table["a"], table["b"]):
            contexts.append(np.frombuffer(codec.decompress(a.as_py(), n * (before + length)), np.uint8).reshape(n, -1))
            heads.append(np.frombuffer(codec.decompress(b.as_py(), n * head_kind.itemsize), head_kind))
        owner = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
        context, head = np.concatenate(contexts), np.concatenate(heads)
        del contexts, heads
        rows_of, starts, ends = repeated_spans(context, head["id"], head["place"], head["right"], length, gram)
        by = np.argsort(owner[rows_of], kind="stable")
        rows_of, starts, ends = rows_of[by], starts[by], ends[by]
        names, out = table["chunk"].to_pylist(), []
        at = np.searchsorted(owner[rows_of], np.arange(len(names) + 1))
        for i, name in enumerate(names):
            s, e = at[i], at[i + 1]
            if s < e:
                out.append((name, None, head["row"][rows_of[s:e]].astype(np.int64).tobytes(), starts[s:e].astype(np.int64).tobytes(), ends[s:e].astype(np.int64).tobytes()))
        return _pack(out, ["chunk", "id", "a", "b", "c"], [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])

    spans = sent.groupBy("part").applyInArrow(compare, side_schema).unionByName(copies)
    kinds = dict(docs.dtypes)
    kept_columns = [(i, c) for i, c in enumerate(columns) if c != text]
    schema = ", ".join([f"_column_{i} {kinds[c]}" for i, c in kept_columns] + [f"_kept {'string' if as_text else 'binary'}, _n_bytes long, _removed array<struct<start:long,end:long>>"])

    def remove(_: tuple, docs_of: pa.Table, side: pa.Table) -> pa.Table:
        skip, (keys, numbers) = copied(side), numbered(docs_of)
        blobs = [(_view(a, np.int64), _view(b, np.int64), _view(c, np.int64)) for a, b, c in zip(side["a"], side["b"], side["c"]) if a.is_valid]
        rows, starts, ends = (np.concatenate([b[k] for b in blobs]) if blobs else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(rows, kind="stable")
        rows, starts, ends = rows[order], starts[order], ends[order]
        kept, sizes, removed = [], [], []
        for key, value in zip(keys, texts(docs_of["_suffix_text"])):
            if key is not None and key in skip:
                runs = (np.array([0]), np.array([len(value)]))
            else:
                s, e = np.searchsorted(rows, [numbers[key], numbers[key] + 1]) if key is not None else (0, 0)
                runs = merge(starts[s:e], ends[s:e])
            rest = cut_text(value, *runs, as_text)
            kept.append(rest.decode() if as_text else rest)
            sizes.append(len(value))
            removed.append([{"start": int(a), "end": int(b)} for a, b in zip(*runs)])
        made = [pa.array(kept, pa.large_string() if as_text else pa.large_binary()).cast(pa.string() if as_text else pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        names = [f"_column_{i}" for i, _ in kept_columns]
        return pa.table([*[docs_of[n] for n in names], *made], names=[*names, "_kept", "_n_bytes", "_removed"])

    done = chunks.cogroup(spans.groupBy("chunk")).applyInArrow(remove, schema)
    back = [F.col("_kept").alias(text) if c == text else F.col(f"_column_{i}").alias(c) for i, c in enumerate(columns)]
    return done.select(*back, F.col("_n_bytes").alias("n_bytes"), F.col("_removed").alias("removed"))
