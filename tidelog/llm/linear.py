"""Linear classifiers over hashed features: the labelled sample, training in one task, weights for all executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime
from . import textkit as K

#: Labelled rows that a classifier is fitted on, at most: those with the smallest hash of their doc_id.
SAMPLE = 4000


#: Bytes of text whose features are held at once, unless a text is longer.
PART_BYTES = 256 << 10


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def sample(docs: DataFrame, labels: DataFrame, target: str, limit: int = SAMPLE) -> DataFrame:
    """(text, label) of at most ``limit`` labelled documents outside the held-out fold.

    A document that is labelled more than once counts as labelled 1 if any of its labels is 1. Null ids and
    labels are left out; of rows that share an id the smallest text counts.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (fold() != 1))
        .groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    # ``limit`` bounds the broadcast side.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label"))


class Model(NamedTuple):
    bias: float
    weights: np.ndarray


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates (FTRL-proximal) for logistic loss."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.root = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """From the sums ``z`` and the roots of the sums of squared gradients."""
        z = self.z[at]
        return np.copysign(np.maximum(np.abs(z) - self.l1, 0.0), -z) / ((self.beta + self.root[at]) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int, weight: float = 1.0) -> None:
        """One example; ``at`` are distinct coordinates. The last coordinate of the model is the bias."""
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = weight * (sigmoid(float(w @ x)) - label) * x
        root = self.root[at]
        higher = np.sqrt(root * root + g * g)
        self.z[at] += g - (higher - root) / self.alpha * w
        self.root[at] = higher

    def model(self) -> Model:
        w = self.weights()
        return Model(float(w[-1]), w[:-1].astype(np.float32))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: DataFrame, train: Callable[[list[tuple[K.Slice, np.ndarray]]], Model]) -> Model:
    """Train in one task on a bounded sample; only the weights come to the driver.

    Without a labelled row the model has weights and bias 0, so that every score is one half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(s, b.column("label").to_numpy()[s.lo : s.hi]) for b in batches for s in K.slices(b.column("text"), PART_BYTES)]
        if parts:
            m = train(parts)
            at = np.flatnonzero(m.weights)
            yield pa.RecordBatch.from_pydict({"size": pa.array([len(m.weights)], pa.int64()), "bias": pa.array([m.bias], pa.float64()), "at": pa.array([at.astype("<i4").tobytes()], pa.binary()), "weights": pa.array([m.weights[at].astype("<f4").tobytes()], pa.binary())})

    got = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(runtime.tidy(run), "size long, bias double, at binary, weights binary").collect()
    if not got:
        return Model(0.0, np.zeros(1, np.float32))
    weights = np.zeros(got[0]["size"], np.float32)
    weights[np.frombuffer(got[0]["at"], "<i4")] = np.frombuffer(got[0]["weights"], "<f4")
    return Model(got[0]["bias"], weights)


def score(docs: DataFrame, model: Model, rate: Callable[[K.Slice, Model], np.ndarray]) -> DataFrame:
    """(doc_id, score) of every row; no shuffle. The broadcast model has a fixed number of weights."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for s in K.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo).cast(pa.int64()), pa.array(rate(s, m), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(runtime.tidy(run), "doc_id long, score double")


def decided(scored: DataFrame, threshold: float) -> DataFrame:
    """Scores with the fold and the decision; a row without an id is in no fold."""
    return scored.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
