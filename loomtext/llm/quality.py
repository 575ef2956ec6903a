"""Quality classifier (1): random Fourier features of document statistics, ridge scores, isotonic calibration.

Cosines of random projections approximate a Gaussian kernel over a text's statistics. Each partition sums its part of
the normal equations; the sums, of a size that only the number of features sets, are added in two levels. The ridge
scores of labelled rows kept out of the fit are then calibrated by isotonic regression over binned counts.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.calibrate import binned_counts, isotonic
from loomtext.llm.common import byte_texts, cut, gram_hashes, hash_words, label_column, with_held_out

FEATURES = 384
BANDWIDTH = 4.0
RIDGE = 1e-3
SEED = 11
LOW, HIGH, BINS = -0.5, 1.5, 2000

#: Byte classes that are counted: A-Z, a-z, digits, non-ASCII, blanks, line ends, sentence signs, ! and ?, quotes, other signs.
_CLASSES = [range(65, 91), range(97, 123), range(48, 58), range(128, 256), (9, 11, 12, 13, 32), (10,), b".,;:", b"!?", b"'\"`()-", b"#*$%&|<>@/\\{}[]_=+~^"]
CLASS_MATRIX = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES):
    CLASS_MATRIX[list(_bytes), _k] = 1


def statistics(text: bytes) -> list[float]:
    """Statistics of a whole text; all are 0 for an empty one."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * N_STATISTICS
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = hist @ CLASS_MATRIX / n
    p = hist[hist > 0] / n
    k = len(words)
    hashed = hash_words(words, k)
    _, counts = np.unique(hashed, return_counts=True)
    lengths = np.fromiter(map(len, words), np.float64, k)
    repeated = []
    for width in (2, 3, 5):
        if k < width:
            repeated.append(0.0)
            continue
        _, c = np.unique(gram_hashes(hashed, width), return_counts=True)
        repeated.append(float(c[c > 1].sum() / c.sum()))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        np.log1p(n), np.log1p(k), lengths.mean(), lengths.std(), lengths.max() ** 0.5, float((lengths <= 3).mean()), float((lengths == 1).mean()),
        *np.sqrt(share), float(-(p * np.log2(p)).sum()), len(counts) / k, float(len(counts) / k**0.5) / 10, counts.max() / k, *repeated,
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), len(zlib.compress(text, 1)) / n,
        float(np.mean([x.rstrip().endswith((b".", b"!", b"?")) for x in lines])),
    ]


N_STATISTICS = 7 + len(_CLASSES) + 7 + 5


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        features = np.cos(z @ self.projection + self.phase) * (2 / self.projection.shape[1]) ** 0.5
        return np.hstack([features, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.fourier(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.x, self.y)


def _matrix(batch) -> np.ndarray:
    return batch.column("stats").values.to_numpy(zero_copy_only=False)[batch.column("stats").offset * N_STATISTICS :].reshape(-1, N_STATISTICS)[: len(batch)]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats of every whole text; null is empty."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values = [statistics(t) for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, stats array<double>")


def _summed(rows: DataFrame, one, size: int, fan_in: int = 32) -> np.ndarray:
    """The sum of one(stats, labels) over all rows: of each partition, of `fan_in` of those, of as many of these, and then here."""

    def record(total: np.ndarray, node: int):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["node", "part"])

    def partial(batches):
        from pyspark import TaskContext

        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += one(_matrix(batch), batch.column("label").to_numpy(zero_copy_only=False))
        yield record(total, TaskContext.get().partitionId() // fan_in)

    def added(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for node, part in zip(batch.column("node").to_pylist(), batch.column("part").to_pylist(), strict=True):
                totals[node] = totals.get(node, 0) + np.frombuffer(part)
        for node, total in totals.items():
            yield record(total, node // fan_in)

    parts = rows.select("stats", "label").mapInArrow(partial, "node long, part binary")
    for _ in range(2):
        parts = parts.repartition("node").mapInArrow(added, "node long, part binary")
    found = parts.collect()
    return np.sum([np.frombuffer(r["part"]) for r in found], axis=0) if found else np.zeros(size)


def fit(labelled: DataFrame, features: int = FEATURES, bandwidth: float = BANDWIDTH, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """labelled: doc_id, stats, label (0.0 or 1.0). A quarter of the rows, by a hash of doc_id, calibrates; the rest fits."""
    d = N_STATISTICS
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    fitted, kept_out = labelled.where(fold != 0), labelled.where(fold == 0)
    moments = _summed(fitted, lambda s, _: np.concatenate([[len(s)], s.sum(0), (s * s).sum(0)]), 1 + 2 * d)
    n = max(moments[0], 1.0)
    mean = moments[1 : 1 + d] / n
    scale = np.sqrt(np.maximum(moments[1 + d :] / n - mean**2, 1e-6))
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(0, 1 / bandwidth, (d, features)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(0), np.zeros(0))
    m = features + 1

    def normal_equations(stats: np.ndarray, labels: np.ndarray) -> np.ndarray:
        z = model.fourier(stats)
        return np.concatenate([(z.T @ z).ravel(), z.T @ labels])

    sums = _summed(fitted, normal_equations, m * m + m)
    penalty = np.eye(m) * ridge * n / features
    penalty[-1, -1] = 1e-9
    model = model._replace(weights=np.linalg.solve(sums[: m * m].reshape(m, m) + penalty, sums[m * m :]))

    def raw(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch))), batch.column("label")], names=["raw", "label"])

    scored = kept_out.select("stats", "label").mapInArrow(raw, "raw double, label double")
    x, y = isotonic(binned_counts(scored, F.col("raw"), F.col("label"), LOW, HIGH, BINS), LOW, HIGH, BINS)
    return model._replace(x=x, y=y)


def score_quality(docs: DataFrame, labels: DataFrame, name: str = "quality") -> DataFrame:
    """Scores every whole text of docs (doc_id, text), learning from labels (doc_id, name) of documents not held out.

    Returns doc_id, held_out (crc32 of doc_id as text leaves 1 by 3), score (0 to 1), predicted (1 from 0.5). An empty
    or null text has all statistics 0 and is scored like others. Rows that repeat a doc_id are scored each by itself;
    contradicting labels take their mean, half counting as 1; a null doc_id has no label and is not held out. Without
    usable labels every score is 0.5. Other columns are ignored.
    """
    stats = cut(with_held_out(with_statistics(docs), 3, 1))
    labelled = cut(stats.where("not held_out").join(label_column(docs.sparkSession, labels, name), "doc_id"))
    model = fit(labelled)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            score = np.clip(model.score(_matrix(batch)), 0, 1) if len(batch) else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return stats.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
