"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector x: its words, hashed, with weights of unit length
together; statistics of its structure, standardised and also as the bins they
fall in; its length by the metadata. The score is the logistic of

    w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

and the pairs cost no more than the terms, since they sum to half of
|sum v_i x_i|^2 - sum |v_i|^2 x_i^2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticevec.llm.common import fold, labelled_sample, utf8, word_hashes

#: Labelled rows that are learned from, at most.
SAMPLE = 4000
WORD_BITS = 16
FACTORS = 8
BINS = 8
THRESHOLD = 0.3
#: The fold of ids whose labels are never read.
FOLDS, HELD_OUT = 5, 0

#: The bytes of each class whose share is a statistic.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"#$%&*", b"|", b"<>{}[]=/\\", b"\"'()-:;"]
_CLASS = np.zeros((256, len(CLASSES) + 1))
for _k, _c in enumerate(CLASSES):
    _CLASS[list(_c), _k] = 1
_CLASS[128:, -1] = 1
STATISTICS = len(CLASSES) + 1 + 9


def features(text: bytes, n_chars: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, their weights, and the statistics of one text; n_chars: its length by the metadata, if that has one."""
    data, n = np.frombuffer(text, np.uint8), max(1, len(text))
    shares = np.zeros(256)
    for a in range(0, len(data), 1 << 22):
        shares += np.bincount(data[a : a + (1 << 22)], minlength=256)
    words = word_hashes(text)
    kinds, counts = np.unique(words, return_counts=True)
    lines = text.split(b"\n")
    k = max(1, len(words))
    chars = len(text) if n_chars is None else n_chars
    stats = [
        np.log1p(len(text)), np.log1p(max(0.0, chars)), np.log1p(len(words)), np.log1p(len(lines)), len(text) / k, len(kinds) / k,
        1 - len(set(lines)) / len(lines), float((words[1:] == words[:-1]).sum()) / k, float(counts.max(initial=0)) / k,
    ]
    buckets, weights = (kinds >> np.uint64(64 - WORD_BITS)).astype(np.int32), np.sqrt(counts)
    return buckets, (weights / max(1e-9, np.sqrt((weights**2).sum()))).astype(np.float32), np.concatenate([shares @ _CLASS / n, stats])


@dataclass
class Model:
    """Of a fixed size, whatever it has learned from."""

    mean: np.ndarray
    scale: np.ndarray
    edges: np.ndarray  # (statistic, bin edge)
    bias: float
    w: np.ndarray
    v: np.ndarray  # (feature, factor)

    def vector(self, buckets: np.ndarray, weights: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and values: words, then standardised statistics, then their bins."""
        z = np.clip((stats - self.mean) / self.scale, -4, 4) / 4
        bins = (stats[:, None] > self.edges).sum(axis=1) + np.arange(STATISTICS) * BINS
        at = (1 << WORD_BITS) + np.concatenate([np.arange(STATISTICS), STATISTICS + bins])
        return np.concatenate([buckets, at]), np.concatenate([weights, z, np.full(STATISTICS, 0.3)])

    def margin(self, index: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[index] * x[:, None]
        return float(self.bias + self.w[index] @ x + 0.5 * ((vx.sum(axis=0) ** 2).sum() - (vx**2).sum()))

    def score(self, text: bytes, n_chars: float | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(*self.vector(*features(text, n_chars))), -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], label: np.ndarray, steps: int = 600, rate: float = 0.02, decay: float = 2e-4, seed: int = 3) -> Model:
    """Adam on the logistic loss. Without rows of both labels the score is the share of ones, or a half without any rows."""
    size, draw = (1 << WORD_BITS) + STATISTICS * (1 + BINS), np.random.default_rng(seed)
    stats = np.array([r[2] for r in rows]) if rows else np.zeros((1, STATISTICS))
    share = (label.sum() + 0.5) / (len(label) + 1)
    model = Model(stats.mean(axis=0), stats.std(axis=0) + 1e-6, np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T, float(np.log(share / (1 - share))), np.zeros(size), draw.normal(0, 0.02, (size, FACTORS)))
    if len(set(label.tolist())) < 2:
        model.v[:] = 0
        return model
    vectors = [model.vector(*r) for r in rows]
    theta = np.concatenate([model.w[:, None], model.v], axis=1)
    m, s, t = np.zeros_like(theta), np.zeros_like(theta), 0
    parts = max(1, len(rows) // 64)
    for _ in range(max(12, -(-steps // parts))):  # small samples are gone through more often
        for batch in np.array_split(draw.permutation(len(rows)), parts):
            index, x = np.concatenate([vectors[k][0] for k in batch]), np.concatenate([vectors[k][1] for k in batch])
            lengths = np.array([len(vectors[k][0]) for k in batch])
            start = np.cumsum(lengths) - lengths
            got = theta[index]
            vx = got[:, 1:] * x[:, None]
            total = np.add.reduceat(vx, start)
            margin = model.bias + np.add.reduceat(got[:, 0] * x, start) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), start))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[batch]) / len(batch)
            e = np.repeat(error, lengths)
            grad = np.concatenate([x[:, None], x[:, None] * (np.repeat(total, lengths, axis=0) - vx)], axis=1) * e[:, None]
            at, inverse = np.unique(index, return_inverse=True)
            summed = np.stack([np.bincount(inverse, grad[:, f], len(at)) for f in range(1 + FACTORS)], axis=1) + decay * theta[at]
            t += 1
            m[at] = 0.9 * m[at] + 0.1 * summed
            s[at] = 0.99 * s[at] + 0.01 * summed**2
            theta[at] -= rate * (m[at] / (1 - 0.9**t)) / (np.sqrt(s[at] / (1 - 0.99**t)) + 1e-8)
            model.bias -= rate * float(error.sum())
    model.w, model.v = theta[:, 0].astype(np.float32), theta[:, 1:].astype(np.float32)
    return model


def _length(docs: DataFrame, n_chars: str | None):
    return (F.col(n_chars).cast("double") if n_chars in docs.columns else F.lit(None).cast("double")).alias("__lv_chars")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", most: int = SAMPLE) -> Model:
    """A model learned from up to ``most`` labelled rows, none of them held out."""
    sample = labelled_sample(docs.select(F.col(doc_id), F.struct(F.col(text).alias("t"), _length(docs, n_chars)).alias("x")), labels, label, fold("doc_id", FOLDS) != HELD_OUT, most, doc_id, "x")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t, c) for t, c in zip(utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
            arrays = [pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32())), pa.array([m[2] for m in made], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "label", "b", "x", "s"])

    flat = sample.select("doc_id", "label", F.col("text.t"), F.col("text.__lv_chars"))
    rows = flat.mapInArrow(scan, "doc_id long, label int, b array<int>, x array<float>, s array<double>").toArrow()
    rows = rows.sort_by([("doc_id", "ascending")])
    each = [(np.array(b, np.int32), np.array(x, np.float32), np.array(s)) for b, x, s in zip(*[rows.column(c).to_numpy() for c in "bxs"], strict=True)]
    return train(each, rows.column("label").to_numpy().astype(float))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null text counts as empty, which has a score like any other. Rows without
    an id are scored and count as held out; repeated rows stay. Without labels
    every score is a half. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shared.value.score(t, c) for t, c in zip(utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.float64())], ["doc_id", "held_out", "score"])

    held = F.coalesce(fold(doc_id, FOLDS) == HELD_OUT, F.lit(True)).alias("held_out")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held, F.col(text).alias("__lv_text"), _length(docs, n_chars))
    out = rows.mapInArrow(scan, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars = batch.column(names.index(n_chars)).to_pylist() if n_chars in names else [None] * batch.num_rows
            good = [shared.value.score(t, c) >= threshold for t, c in zip(utf8(batch.column(names.index(text))), chars, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
