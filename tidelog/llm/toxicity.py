"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the hashed runs of three to six bytes of the lower-cased text in which every run of other
characters than letters and digits is one blank, so that a blank marks the ends of words. A feature is present
or absent in a document. Its naive Bayes ratio is log((p / |p|) / (q / |q|)), p and q being the smoothed numbers of
documents of either class with it; logistic regression is fitted to the presence times that ratio, with a penalty
that leaves weights only where they matter. A document's score sums the weights of the features it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import linear, runtime
from . import textkit as K

BITS = 20
SIZES = (3, 4, 5, 6)
#: Documents of the sample that must have a feature before it counts.
LEAST = 6
EPOCHS = 4
THRESHOLD = 0.7
PENALTIES = (0.5, 1.0, 2.0)


def _plain(s: K.Slice) -> K.Slice:
    """The lower-cased text with one blank before the words of a row and after each of them."""
    a, b = K.spans(s, K.ALNUM)
    n = s.hi - s.lo
    counts = np.bincount(s.rows_of(a), minlength=n) if len(a) else np.zeros(n, np.int64)
    ends = np.cumsum(counts)
    lengths = b - a + 1
    at = np.concatenate([[0], np.cumsum(lengths)])
    out = np.full(at[-1] + n, 0x20, np.uint8)
    before = np.repeat(np.arange(1, n + 1), counts)  # blanks that begin this row and those before it
    places = np.arange(at[-1]) + np.repeat(before, lengths)
    last = np.zeros(at[-1], bool)
    last[at[1:] - 1] = True
    source = np.arange(at[-1]) + np.repeat(a - at[:-1], lengths)
    out[places[~last]] = K.LOWER[s.buf[source[~last]]]
    offsets = np.concatenate([[0], at[ends] + np.arange(1, n + 1)])
    return K.Slice(s.lo, s.hi, out, offsets)


def _places(t: K.Slice, size: int, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature at each place of the text, whether it lies in one row)."""
    n = len(t.buf) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    _, down = K.powers(len(prefix))
    h = K.mix((prefix[size:] - prefix[:-size]) * down[:n] + K.U64(size))
    inside = np.ones(n, bool)
    for k in range(1, size):
        cut = t.offsets[1:-1] - k
        inside[cut[(cut >= 0) & (cut < n)]] = False
    return (h >> K.U64(64 - BITS)).astype(np.int64), inside


def present(s: K.Slice, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of each feature that a row has, once; only those ``wanted``, if given."""
    t = _plain(s)
    prefix = K.prefix_hash(t.buf)
    keys = []
    for size in SIZES:
        feature, keep = _places(t, size, prefix)
        if wanted is not None:
            keep &= wanted[feature]
        at = np.flatnonzero(keep)
        keys.append(t.rows_of(at) << BITS | feature[at])
    key = K.distinct(np.concatenate(keys))
    return key & ((1 << BITS) - 1), key >> BITS


def _counts(parts: list[tuple[K.Slice, np.ndarray]], inner: np.ndarray) -> np.ndarray:
    """[inner, class, feature]: documents of class 0 and 1 that have each feature, within the inner test and outside it."""
    having, at = np.zeros((2, 2, 1 << BITS), np.int64), 0
    for s, labels in parts:
        feature, row = present(s)
        group = 2 * inner[at : at + len(labels)] + (labels == 1)
        for k in range(4):
            having[k >> 1, k & 1] += np.bincount(feature[group[row] == k], minlength=1 << BITS)
        at += len(labels)
    return having


def log_ratios(having: np.ndarray, documents: tuple[int, int]) -> np.ndarray:
    """Naive Bayes log-count ratios; 0 for features that are rare or that chance explains."""
    ratio = np.log((having[1] + 1) / (documents[1] + 2)) - np.log((having[0] + 1) / (documents[0] + 2))
    ratio[having.sum(axis=0) < LEAST] = 0
    # A ratio that the smaller class's chance variation explains says nothing.
    ratio[np.abs(ratio) < 3 / np.sqrt(having.min(axis=0) + 1)] = 0
    return ratio


def _learnt(examples: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, penalty: float) -> linear.Model:
    ones = max(1, int((labels == 1).sum()))
    weight = {1: len(labels) / 2 / ones, 0: len(labels) / 2 / max(1, len(labels) - ones)}
    learner = linear.Ftrl(len(ratio), alpha=0.1, beta=1.0, l1=penalty, l2=0.1)
    order = np.random.default_rng(8)
    for _ in range(EPOCHS):
        for i in order.permutation(len(examples)):
            y = int(labels[i] == 1)
            learner.learn(examples[i], ratio[examples[i]], y, weight[y])
    m = learner.model()
    return linear.Model(m.bias, m.weights * ratio)


def train(parts: list[tuple[K.Slice, np.ndarray]]) -> linear.Model:
    """Two passes over the texts: the counts of all features, then the examples' features that have a ratio.

    The penalty is that of PENALTIES with the fewest wrong decisions on every fourth example, learnt from the
    others, the strongest of equals; the model is then learnt from all examples.
    """
    labels = np.concatenate([marks for _, marks in parts])
    inner = np.arange(len(labels)) % 4 == 3
    having = _counts(parts, inner.astype(np.int64))
    documents = lambda among: tuple(max(1, int(((labels == 1) == y)[among].sum())) for y in (False, True))
    ratio = log_ratios(having.sum(axis=0), documents(slice(None)))
    inner_ratio = log_ratios(having[0], documents(~inner))
    used = np.flatnonzero((ratio != 0) | (inner_ratio != 0))
    wanted, number = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.int32)
    wanted[used], number[used] = True, np.arange(len(used))
    examples: list[np.ndarray] = []
    for s, marks in parts:
        feature, row = present(s, wanted)
        examples += np.split(number[feature], np.searchsorted(row, np.arange(1, len(marks))))

    def wrong(penalty: float) -> int:
        m = _learnt([examples[i] for i in np.flatnonzero(~inner)], labels[~inner], inner_ratio[used], penalty)
        return sum((linear.sigmoid(m.bias + m.weights[examples[i]].sum()) >= THRESHOLD) != (labels[i] == 1) for i in np.flatnonzero(inner))

    m = _learnt(examples, labels, ratio[used], min(PENALTIES, key=lambda p: (wrong(p), -p)))
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = m.weights
    return linear.Model(m.bias, weights)


def rate(s: K.Slice, m: linear.Model) -> np.ndarray:
    n = s.hi - s.lo
    if len(m.weights) == 1:
        return np.full(n, 0.5)
    feature, row = present(s, m.weights != 0)
    return linear.sigmoid(m.bias + np.bincount(row, weights=m.weights[feature], minlength=n))


def fit(docs: DataFrame, labels: DataFrame, sample: int = linear.SAMPLE) -> linear.Model:
    runtime.ship(docs.sparkSession)
    return linear.fit(linear.sample(docs, labels, "toxic", sample), train)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = linear.SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, toxic).

    A null text is empty and has the score of the bias. Repeated rows get equal scores, a row without a doc_id is
    in no fold. An empty table gives an empty one. A very long text is read in one piece. Without labels every score is 0.5. The model is fitted on at most ``sample`` labelled rows outside the held-out fold.
    """
    return linear.decided(linear.score(docs, fit(docs, labels, sample), rate), THRESHOLD)


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = linear.SAMPLE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, others) that :func:`score_toxicity` does not reject, with all their columns.

    Null texts count as empty; rows without a doc_id are judged like all others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    columns = docs.columns
    text = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(text)):
                yield batch.slice(s.lo, s.hi - s.lo).filter(pa.array(rate(s, shared.value) < THRESHOLD))

    return docs.mapInArrow(runtime.tidy(run), docs.schema)
