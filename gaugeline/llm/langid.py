"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a letter run with a blank on both ends, forwards and backwards, and labels every letter's
position with language probabilities; a document's probabilities are the mean over all its positions. States begin anew
with every run, so memory does not depend on the length of a text, and equal runs of a task share one pass.

Training is numpy back-propagation through time on the driver, over a bounded sample: per language the `train_docs` first
documents in hash order among those of at most `train_bytes` bytes, as whole texts. Everything else runs in the tasks.
Null texts and texts without a letter are `und` with score 0; so is every text if nothing could be learned. Rows are
labelled each for itself, so repeated rows, null ids and extra columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRAIN_DOCS, TRAIN_BYTES = 300, 8192
HIDDEN, STEPS, BATCH, RATE, SEED = 16, 700, 256, 0.01, 7
RUN_BYTES = 40  # longer runs are read in pieces
CACHED_RUNS = 800_000
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def runs_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def pack(runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces as rows of bytes, zero-padded, with blanks at both ends; lengths; which bytes begin a letter; owner of each piece."""
    pieces, owner = [], []
    for i, run in enumerate(runs):
        data = run.encode()
        for at in range(0, len(data), RUN_BYTES):
            pieces.append(data[at:at + RUN_BYTES])
            owner.append(i)
    lengths = np.array([len(p) + 2 for p in pieces])
    rows = np.zeros((len(pieces), lengths.max()), np.uint8)
    for i, piece in enumerate(pieces):
        rows[i, 1:len(piece) + 1] = np.frombuffer(piece, np.uint8)
    rows[:, 0] = 32
    rows[np.arange(len(pieces)), lengths - 1] = 32
    letters = (rows > 32) & ((rows & 0xC0) != 0x80)
    return rows, lengths, letters, np.array(owner)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights of both directions and of the output layer; float32 throughout."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.classes, self.hidden = classes, hidden
        f = lambda *shape: (rng.standard_normal(shape) * 0.3 / np.sqrt(shape[0] if len(shape) > 1 and shape[0] != 256 else 1)).astype(np.float32)
        self.weights = {
            **{f"x{d}": f(256, 3 * hidden) for d in "fb"}, **{f"h{d}": f(hidden, 3 * hidden) for d in "fb"},
            **{f"b{d}": np.zeros(3 * hidden, np.float32) for d in "fb"}, "out": f(2 * hidden, len(classes)), "bias": np.zeros(len(classes), np.float32),
        }

    def direction(self, rows: np.ndarray, live: np.ndarray, d: str, keep: bool = False):
        """States after every position; with `keep`, what back-propagation needs."""
        w, n = self.weights, self.hidden
        inputs, order = w[f"x{d}"] + w[f"b{d}"], range(rows.shape[1]) if d == "f" else range(rows.shape[1] - 1, -1, -1)
        state, states, kept = np.zeros((len(rows), n), np.float32), np.zeros((rows.shape[1], len(rows), n), np.float32), {}
        for t in order:
            x, g = inputs[rows[:, t]], state @ w[f"h{d}"]
            gates = _sigmoid(x[:, :2 * n] + g[:, :2 * n])
            z, r = gates[:, :n], gates[:, n:]
            c = np.tanh(x[:, 2 * n:] + r * g[:, 2 * n:])
            new = c + z * (state - c)
            if not live[:, t].all():
                new = np.where(live[:, t, None], new, state)
            if keep:
                kept[t] = (state, z, r, c, g[:, 2 * n:])
            states[t] = state = new
        return states, kept, list(order)

    def probabilities(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(rows, positions, classes)"""
        live = np.arange(rows.shape[1])[None, :] < lengths[:, None]
        both = np.concatenate([self.direction(rows, live, d)[0] for d in "fb"], 2)
        logits = both @ self.weights["out"] + self.weights["bias"]
        p = np.exp(logits - logits.max(2, keepdims=True))
        return (p / p.sum(2, keepdims=True)).transpose(1, 0, 2)

    def gradients(self, rows: np.ndarray, lengths: np.ndarray, letters: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all letters, and its gradient by back-propagation through time."""
        w, n = self.weights, self.hidden
        live = np.arange(rows.shape[1])[None, :] < lengths[:, None]
        done = {d: self.direction(rows, live, d, True) for d in "fb"}
        both = np.concatenate([done[d][0] for d in "fb"], 2)
        logits = both @ w["out"] + w["bias"]
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        on = letters.T.astype(np.float32) / max(1, letters.sum())
        loss = -float((np.log(p[:, np.arange(len(rows)), target] + 1e-9) * on).sum())
        p[:, np.arange(len(rows)), target] -= 1
        p *= on[:, :, None]
        grads = {"out": np.tensordot(both, p, ((0, 1), (0, 1))), "bias": p.sum((0, 1))}
        back = p @ w["out"].T
        for k, d in enumerate("fb"):
            _, kept, order = done[d]
            dx, dh = np.zeros_like(w[f"x{d}"]), np.zeros_like(w[f"h{d}"])
            flow = np.zeros((len(rows), n), np.float32)
            for t in reversed(order):
                state, z, r, c, gc = kept[t]
                flow = flow + back[t, :, k * n:(k + 1) * n]
                on_t = live[:, t, None]
                dnew = np.where(on_t, flow, 0)
                dc = dnew * (1 - z) * (1 - c * c)
                dz = dnew * (state - c) * z * (1 - z)
                dr = dc * gc * r * (1 - r)
                dg = np.concatenate([dz, dr, dc * r], 1)
                np.add.at(dx, rows[:, t], np.concatenate([dz, dr, dc], 1))
                dh += state.T @ dg
                flow = np.where(on_t, dnew * z + dg @ w[f"h{d}"].T, flow)
            grads |= {f"x{d}": dx, f"h{d}": dh, f"b{d}": dx.sum(0)}
        return loss, grads

    def fit(self, runs: list[str], targets: np.ndarray, weights: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> list[float]:
        """Adam over batches drawn in proportion to the weights."""
        rng, losses = np.random.default_rng(seed), []
        share = np.cumsum(weights / weights.sum())
        m, v = ({k: np.zeros_like(x) for k, x in self.weights.items()} for _ in range(2))
        for step in range(1, steps + 1):
            chosen = np.minimum(np.searchsorted(share, rng.random(batch)), len(runs) - 1)
            rows, lengths, letters, owner = pack([runs[i] for i in chosen])
            loss, grads = self.gradients(rows, lengths, letters, targets[chosen][owner])
            losses.append(loss)
            now = rate * (1 - step / (steps + 1))
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.weights[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return losses

    def run_sums(self, runs: list[str], batch: int = 4096) -> np.ndarray:
        """Per run: summed probabilities of its letters, and their number in the last column."""
        out = np.zeros((len(runs), len(self.classes) + 1), np.float32)
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        for at in range(0, len(order), batch):
            part = order[at:at + batch]
            rows, lengths, letters, owner = pack([runs[i] for i in part])
            p = self.probabilities(rows, lengths) * letters[:, :, None]
            np.add.at(out, np.array(part)[owner], np.concatenate([p.sum(1), letters.sum(1, keepdims=True)], 1))
        return out


class Numbers(dict):
    """Numbers keys as they come and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = number = len(self)
        return number


class Labeller:
    """Labels texts; remembers the sums of the runs it has seen, up to a bound on their number."""

    def __init__(self, network: Network):
        self.network, self.place, self.sums = network, Numbers(), np.zeros((0, len(network.classes) + 1), np.float32)

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.place) > CACHED_RUNS:
            self.place, self.sums = Numbers(), self.sums[:0]
        numbers = []
        for text in texts:
            runs = runs_of(text) if text else []
            numbers.append(np.fromiter(map(self.place.__getitem__, runs), np.int32, len(runs)))
        if self.place.new:
            self.sums = np.concatenate([self.sums, self.network.run_sums(self.place.new)])
            self.place.new = []
        names, scores = [], []
        for text, runs in zip(texts, numbers):
            pooled = self.sums[runs].sum(0, dtype=np.float64) if len(runs) else None
            if pooled is None or not pooled[-1] or not any(map(str.isalpha, text)):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(np.argmax(pooled[:-1]))
            names.append(self.network.classes[best])
            scores.append(float(min(1.0, pooled[best] / pooled[-1])))
        return names, scores


_READY: dict[bytes, Labeller] = {}  # one per model and Python worker, kept from task to task


def _labeller(classes: list[str], hidden: int, weights: dict[str, np.ndarray]) -> Labeller:
    key = b"".join(w.tobytes() for w in weights.values())
    if key not in _READY:
        _READY.clear()
        network = Network(classes, hidden)
        network.weights = weights
        _READY[key] = Labeller(network)
    return _READY[key]


def train(docs: DataFrame, use: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Network | None:
    """Fits a network on a bounded sample of the rows for which `use` holds; None if there is nothing to learn from."""
    rows = docs.where(use & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.octet_length(text) <= train_bytes)).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("ord")
    )
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("ord", "text"))).where(F.col("n") <= train_docs)
    sample = first.orderBy("lang", "n").select("lang", "text").toPandas()
    classes = sorted(sample["lang"].unique())
    counts: dict[tuple[str, int], int] = {}
    for name, value in zip(sample["lang"], sample["text"]):
        for run in runs_of(value):
            key = (run, classes.index(name))
            counts[key] = counts.get(key, 0) + 1
    if not counts:
        return None
    keys = sorted(counts)
    per_class = np.bincount([k[1] for k in keys], [np.sqrt(counts[k]) for k in keys], len(classes))
    weights = np.array([np.sqrt(counts[k]) / per_class[k[1]] for k in keys])
    network = Network(classes)
    network.fit([k[0] for k in keys], np.array([k[1] for k in keys]), weights)
    return network


def label_documents(docs: DataFrame, network: Network | None, doc_id: str = "doc_id", text: str = "text", group_bytes: int = 1 << 20) -> DataFrame:
    """Per row: `doc_id`, `lang_pred`, `score`. Texts are read in groups of about `group_bytes`."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if network is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    classes, hidden, weights = network.classes, network.hidden, network.weights

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _labeller(classes, hidden, weights)
        for batch in batches:
            column, names, scores, group, held = batch.column(1), [], [], [], 0
            for i in range(len(column)):
                value = column[i].as_py()
                group.append(value)
                held += len(value or "")
                if held >= group_bytes or i + 1 == len(column):
                    for to, more in zip((names, scores), labeller.label(group)):
                        to.extend(more)
                    group, held = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(label, f"doc_id {kind}, lang_pred string, score double")
