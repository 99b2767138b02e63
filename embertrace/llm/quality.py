"""Quality classifier: ridge regression on random Fourier features of document statistics.

Statistics of a whole text (lengths, character classes, repetition) are standardised and mapped through
cosines of random projections, which approximate a Gaussian kernel. The normal equations of a ridge fit
are sums over rows, so each partition adds up its own and the sums are added in rounds. Two half fits
score each other's rows, and isotonic regression over those scores makes the final score a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace.llm.common import schema_with, slices, texts_of, written

FEATURES = 256
WIDTH = 4.0  # of the Gaussian kernel, in standard deviations of the statistics
RIDGE = 1e-3  # per row
GRID = 1000  # score bins of the calibration
THRESHOLD = 0.3
NO_LABELS = 0.5  # score of every text where nothing is labelled

LOWER = np.array([97 <= b <= 122 for b in range(256)])
UPPER = np.array([65 <= b <= 90 for b in range(256)])
DIGIT = np.array([48 <= b <= 57 for b in range(256)])
SPACE = np.array([b in (9, 10, 11, 12, 13, 32) for b in range(256)])
WIDE = np.array([b >= 128 for b in range(256)])
COMMON_MARKS = np.array([chr(b) in ".,;:?'\"-()" for b in range(256)])
RARE_MARKS = ~(LOWER | UPPER | DIGIT | SPACE | WIDE | COMMON_MARKS)
CLASSES = np.stack([LOWER, UPPER, DIGIT, SPACE, WIDE, COMMON_MARKS, RARE_MARKS], 1).astype(float)
STATISTICS = CLASSES.shape[1] + 10


def statistics(texts: list[str]) -> np.ndarray:
    """One row of finite numbers per text; all zero but for the first for an empty one."""
    out = np.zeros((len(texts), STATISTICS))
    counts = np.zeros((len(texts), 256))
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        words, lines = data.lower().split(), data.split(b"\n")
        raw = np.frombuffer(data, np.uint8)
        counts[i] = np.bincount(raw, minlength=256)
        n, w = max(1, len(data)), max(1, len(words))
        distinct_lines = set(lines)
        out[i, :10] = (
            np.log1p(len(data)), np.log1p(len(words)), (len(data) - counts[i][SPACE].sum()) / w, len(set(words)) / w,
            len(distinct_lines) / len(lines), sum(map(len, distinct_lines)) / n, np.log1p(len(lines)),
            np.count_nonzero(raw[1:] == raw[:-1]) / n, 0.0, len(words) / len(lines) / 100)
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    out[:, 8] = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    out[:, 10:] = share @ CLASSES
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None  # None: nothing is labelled
    knots: np.ndarray  # ridge scores, ascending
    levels: np.ndarray  # their probabilities, ascending

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.cos(x @ self.omega + self.phase) * np.sqrt(2.0 / len(self.phase))

    def raw(self, stats: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return self.features(stats) @ weights[:-1] + weights[-1]

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), NO_LABELS)
        return np.interp(self.raw(stats, self.weights), self.knots, self.levels)


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values`` in weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(``keep``, stats): statistics of each text as one binary of doubles."""
    kept = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [r.tobytes() for r in statistics(texts_of(part))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, pa.binary())], [*part.schema.names[:-1], "stats"])

    return kept.mapInArrow(run, schema_with(kept.drop("text"), "stats binary"))


def _matrix(part: pa.RecordBatch, name: str = "stats") -> np.ndarray:
    rows = part.column(part.schema.get_field_index(name)).to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), STATISTICS)


def _summed(df: DataFrame, make, size: int, groups: int) -> np.ndarray:
    """Sum over all rows of ``make(batch)``, an array of (groups, size): in each partition, then over
    32 partitions' sums at a time until few are left for the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((groups, size))
        for part in slices(batches, 4096):
            total += make(part)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(groups * size)
        for part in batches:
            for row in part.column(0).to_pylist():
                total += np.frombuffer(row, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    sums, parts = df.mapInArrow(run, "sums binary"), df.rdd.getNumPartitions()
    while parts > 32:
        parts = -(-parts // 32)
        sums = sums.repartition(parts).mapInArrow(add, "sums binary")
    rows = sums.collect()
    return sum((np.frombuffer(r[0], np.float64) for r in rows), np.zeros(groups * size)).reshape(groups, size)


def fit(labelled: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = 11) -> QualityModel:
    """Learn from rows (stats, label 0 or 1, half 0 or 1); rows with other labels are left out."""
    rng = np.random.default_rng(seed)
    rows = labelled.where(F.col("label").isin(0, 1)).select("stats", F.col("label").cast("double"), F.col("half").cast("int").alias("half"))
    rows = written(rows, "labelled")  # read by three passes

    def moments(part: pa.RecordBatch) -> np.ndarray:
        x = _matrix(part)
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])[None]

    m = _summed(rows, moments, 1 + 2 * STATISTICS, 1)[0]
    n = max(1.0, m[0])
    mean = m[1 : 1 + STATISTICS] / n
    scale = np.sqrt(np.maximum(m[1 + STATISTICS :] / n - mean**2, 0))
    scale = np.where(scale > 1e-6, scale, 1.0)  # a constant statistic says nothing
    model = QualityModel(mean, scale, rng.normal(0, 1 / width, (STATISTICS, features)), rng.uniform(0, 2 * np.pi, features), None,
                         np.zeros(1), np.full(1, NO_LABELS))
    if m[0] == 0:
        return model
    d = features + 1

    def equations(part: pa.RecordBatch) -> np.ndarray:
        z = np.column_stack([model.features(_matrix(part)), np.ones(part.num_rows)])
        y, half = part.column(1).to_numpy(), part.column(2).to_numpy()
        return np.stack([np.concatenate([(z[half == h].T @ z[half == h]).ravel(), z[half == h].T @ y[half == h], [np.sum(half == h)]]) for h in (0, 1)])

    halves = _summed(rows, equations, d * d + d + 1, 2)

    def solve(sums: np.ndarray) -> np.ndarray:
        a = sums[: d * d].reshape(d, d) + ridge * max(1.0, sums[-1]) * np.diag([1.0] * features + [1e-6])
        return np.linalg.solve(a, sums[d * d : -1])

    cross = [solve(halves[1]), solve(halves[0])]  # a half is scored by the other half's fit
    low, high = -0.5, 1.5

    def binned(part: pa.RecordBatch) -> np.ndarray:
        x, y, half = _matrix(part), part.column(1).to_numpy(), part.column(2).to_numpy()
        raw = np.where(half == 0, model.raw(x, cross[0]), model.raw(x, cross[1]))
        at = np.clip(((raw - low) / (high - low) * GRID).astype(int), 0, GRID - 1)
        return np.stack([np.bincount(at, minlength=GRID), np.bincount(at, weights=y, minlength=GRID), np.bincount(at, weights=raw, minlength=GRID)])

    counts, ones, sums = _summed(rows, binned, GRID, 3)
    some = counts > 0
    model.weights = solve(halves.sum(0))
    model.knots = sums[some] / counts[some]
    model.levels = pool_adjacent(ones[some] / counts[some], counts[some])
    return model


def scored(stats: DataFrame, model: QualityModel) -> DataFrame:
    """``stats`` with its statistics replaced by score (0 to 1)."""
    shared = stats.sparkSession.sparkContext.broadcast(model)  # a few hundred kilobytes, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(shared.value.score(_matrix(part)))], [*part.schema.names[:-1], "score"])

    return stats.mapInArrow(run, schema_with(stats.drop("stats"), "score double"))


def labelled_statistics(stats: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """Rows of ``fit``: ``stats`` (doc_id, fold, stats) with labels (doc_id, quality) by id. Null ids and
    labels join nothing; an id labelled twice counts twice."""
    marks = labels.select("doc_id", F.col("quality").alias("label")).where("doc_id is not null and label is not null")
    return stats.where(usable).join(marks, "doc_id").select("stats", "label", (F.xxhash64("doc_id") % 2 == 0).cast("int").alias("half"))


def predict(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """``docs`` with the score of its text appended; a column of this name is refused, take another one.
    A null text is empty; empty texts are scored like others; without labels every score is 0.5."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {name} exists already; pass another name")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            scores = pa.array(shared.value.score(statistics(texts_of(part))))
            yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, name])

    return docs.mapInArrow(run, schema_with(docs, f"`{name}` double"))
