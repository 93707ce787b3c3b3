"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

Statistics of the whole text (lengths, character classes, word and line shapes, repetition) are computed once per row.
Random Fourier features approximate a Gaussian kernel over the standardised statistics. Each task adds up the normal
equations of its labelled rows; the cells of the sums are added up by Spark, and only one fixed-size matrix reaches the
driver. Ridge scores are calibrated by pool-adjacent-violators over labelled rows that the regression has not seen, counted
on a grid of scores. All labelled training rows take part.

Empty and null texts have all-zero statistics and get a score like any other. Null labels are ignored; repeated labels of a
document are averaged and rounded. If only one class is labelled, every score is that class; without labels every score is
1, so that nothing is rejected. Repeated rows, null ids and extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.arrowtext import texts
from gaugeline.session import cut_lineage

FEATURES, RIDGE, SEED, GRID = 128, 1e-3, 11, 500
THRESHOLD = 0.7

_CLASS = np.zeros(256, np.int64)  # 0 other ASCII signs, 1 white space, 2 digits, 3 capitals, 4 small letters, 5 non-ASCII, 6 . and ,
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 2, 3, 4, 5
_CLASS[[44, 46]] = 6
_SPACE = _CLASS == 1
N_STATS = 18


def statistics(text: bytes) -> np.ndarray:
    out = np.zeros(N_STATS)
    if not text:
        return out
    data = np.frombuffer(text, np.uint8)
    counts = np.bincount(data, minlength=256)
    kinds = np.bincount(_CLASS, counts, 7) / len(data)
    words = text.split()
    ends = np.flatnonzero(_SPACE[data])
    lengths = np.diff(np.concatenate([[-1], ends, [len(data)]])) - 1
    lengths = lengths[lengths > 0]
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    share = counts[counts > 0] / len(data)
    signs = counts[[33, 35, 36, 37, 38, 42]].sum()
    out[:] = (
        np.log1p(len(data)), np.log1p(len(words)), lengths.mean() if len(lengths) else 0, lengths.std() if len(lengths) else 0,
        kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], signs / n, counts[124] / n,
        len(set(words)) / n, len(set(lines)) / m, np.log1p(len(data) / m), (lengths <= 3).mean() if len(lengths) else 0, -(share * np.log(share)).sum(),
    )
    return out


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: `doc_id`, `stats` array<double>."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return rows.mapInArrow(measure, f"doc_id {dict(rows.dtypes)['doc_id']}, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray

    def expand(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / len(self.phases)) * np.cos(x @ self.waves + self.phases), np.ones((len(x), 1))], 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.values[0])
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0.0, 1.0)


def _stack(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(-1, N_STATS)


def isotonic(scores: np.ndarray, positives: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over increasing scores: centres and values of the pooled blocks."""
    blocks: list[list[float]] = []
    for s, p, n in zip(scores, positives, totals):
        blocks.append([s * n, p, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, use: Column, doc_id: str = "doc_id", label: str = "quality", features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Learns from `labels` rows for which `use` holds; a quarter of the documents, by hash, is left to the calibration."""
    wanted = (
        labels.where(use & F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("doc_id")).agg(F.round(F.avg(label)).alias("y"))
    )
    known = cut_lineage(stats.join(wanted, "doc_id").select("stats", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("held")))
    moments = known.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("p"),
        *[F.avg(F.get("stats", F.lit(i))).alias(f"m{i}") for i in range(N_STATS)],
        *[F.stddev_pop(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(N_STATS)],
    ).first()
    rng = np.random.default_rng(seed)
    if not moments["n"] or moments["p"] in (0, moments["n"]):
        value = 1.0 if not moments["n"] else float(moments["p"] > 0)
        return Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros((N_STATS, 1)), np.zeros(1), None, np.zeros(1), np.array([value]))
    mean = np.array([moments[f"m{i}"] for i in range(N_STATS)])
    scale = np.array([moments[f"s{i}"] for i in range(N_STATS)])
    scale[scale < 1e-9] = 1.0
    waves = rng.standard_normal((N_STATS, features)) / (1.5 * np.sqrt(N_STATS))
    model = Model(mean, scale, waves, rng.uniform(0, 2 * np.pi, features), None, np.zeros(1), np.zeros(1))
    upper = np.triu_indices(features + 1)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for batch in batches:
            if len(batch):
                z, y = model.expand(_stack(batch.column(0))), batch.column(1).to_numpy()
                gram += z.T @ z
                right += z.T @ y
        cells = np.concatenate([gram[upper], right])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells)), pa.int32()), pa.array(cells)], ["cell", "value"])

    part = known.where(~F.col("held"))
    sums = part.select("stats", "y").mapInArrow(add_up, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).orderBy("cell").toPandas()["value"].to_numpy()
    gram = np.zeros((features + 1, features + 1))
    gram[upper] = sums[:-features - 1]
    gram = gram + np.triu(gram, 1).T
    n = max(1.0, gram[-1, -1])
    model.weights = np.linalg.solve(gram + ridge * n * np.eye(features + 1), sums[-features - 1:])

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.clip(np.rint(model.raw(_stack(batch.column(0))) * GRID), -GRID, 2 * GRID).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], ["bin", "y"])

    for rows in (known.where("held"), known):  # a small table may have no second class among the rows left out
        bins = rows.select("stats", "y").mapInArrow(grid, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).orderBy("bin").toPandas()
        if 0 < bins["p"].sum() < bins["n"].sum():
            break
    model.knots, model.values = isotonic(bins["bin"].to_numpy() / GRID, bins["p"].to_numpy(float), bins["n"].to_numpy(float))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """Per row of `stats`: `doc_id`, `score`."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_stack(batch.column(1))), pa.float64())], ["doc_id", "score"])

    return stats.mapInArrow(rate, f"doc_id {dict(stats.dtypes)['doc_id']}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of `docs` whose score reaches the threshold, measured and scored in one pass."""
    place = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(t) for t in texts(batch.column(place))]).reshape(-1, N_STATS)
            yield batch.filter(pa.array(model.score(stats) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
