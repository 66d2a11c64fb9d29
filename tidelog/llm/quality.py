"""Quality classifier: hashed word n-grams, logistic regression trained by FTRL-proximal, sparse dot products.

A token is a run of letters and digits (with everything beyond ASCII) or a run of other printing characters.
Its features are the word n-grams of one and two tokens, and the n-grams of one to three token shapes: case and
length of a word, the characters of a punctuation run, and whether a word repeats the one before it. A feature's
value is its share of the document's tokens, so a score does not depend on length; a text without tokens has the
score of the bias alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import linear, runtime
from . import textkit as K

BITS = 18
SCALE = 20.0
EPOCHS = 4
THRESHOLD = 0.5

_SPACE = ~K.SPACED
_KIND = np.where(_SPACE, 0, np.where(K.ALNUM, 1, 2)).astype(np.uint8)
_UPPER = K.byte_table(range(0x41, 0x5B))
_DIGIT = K.byte_table(range(0x30, 0x3A))
_LOWER = K.byte_table(range(0x61, 0x7B))


def _tokens(s: K.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = _KIND[s.buf]
    edge = np.zeros(len(kind) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[s.offsets] = True
    cuts = np.flatnonzero(edge)
    kinds = kind[cuts[:-1]]
    keep = kinds > 0
    return cuts[:-1][keep], cuts[1:][keep], kinds[keep]


def features(s: K.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature of each place, its row, number of tokens of each row)."""
    n = s.hi - s.lo
    if not len(s.buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    a, b, kind = _tokens(s)
    rows = s.rows_of(a)
    word = K.span_hash(K.prefix_hash(s.buf), a, b)
    prefix = lambda table: np.concatenate([[0], np.cumsum(table[s.buf], dtype=np.int32)])
    up, low, digit = (p[b] - p[a] for p in map(prefix, (_UPPER, _LOWER, _DIGIT)))
    case = np.where(digit > 0, 3, np.where(up == 0, 0, np.where(low == 0, 2, 1))) + 4 * (np.minimum(b - a, 15) // 4)
    same = np.zeros(len(a), bool)
    same[1:] = (word[1:] == word[:-1]) & (rows[1:] == rows[:-1])
    shape = np.where(kind == 1, K.mix((case + 64 * same + 1).astype(K.U64)), word)
    out, of = [], []

    def add(values: np.ndarray, kind: int, width: int) -> None:
        h = K.mix(values + K.U64(kind))
        keep = rows[width - 1 :] == rows[: len(rows) - width + 1] if width > 1 else slice(None)
        out.append((h >> K.U64(64 - BITS))[keep].astype(np.int64))
        of.append(rows[: len(rows) - width + 1][keep])

    add(word, 1, 1)
    add(shape, 2, 1)
    if len(a) > 1:
        add(word[:-1] * K.U64(3) + word[1:], 3, 2)
        add(shape[:-1] * K.U64(3) + shape[1:], 4, 2)
    if len(a) > 2:
        add(shape[:-2] * K.U64(9) + shape[1:-1] * K.U64(3) + shape[2:], 5, 3)
    return np.concatenate(out), np.concatenate(of), np.bincount(rows, minlength=n)


def train(parts: list[tuple[K.Slice, np.ndarray]]) -> linear.Model:
    examples = []
    for s, labels in parts:
        feature, rows, tokens = features(s)
        key, count = np.unique(rows << BITS | feature, return_counts=True)
        ends = np.searchsorted(key, np.arange(len(labels) + 1) << BITS)
        for i, label in enumerate(labels):
            a, b = ends[i], ends[i + 1]
            examples.append((key[a:b] & ((1 << BITS) - 1), SCALE * count[a:b] / max(1, tokens[i]), int(label)))
    ones = sum(label for *_, label in examples)
    weight = {1: len(examples) / 2 / max(1, ones), 0: len(examples) / 2 / max(1, len(examples) - ones)}
    learner = linear.Ftrl(1 << BITS, alpha=0.5, beta=1.0, l1=0.05, l2=0.1)
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(examples)):
            at, x, label = examples[i]
            learner.learn(at, x, label, weight[label])
    return learner.model()


def rate(s: K.Slice, m: linear.Model) -> np.ndarray:
    n = s.hi - s.lo
    if len(m.weights) == 1:
        return np.full(n, 0.5)
    feature, rows, tokens = features(s)
    total = np.bincount(rows, weights=m.weights[feature], minlength=n)
    return linear.sigmoid(m.bias + SCALE * total / np.maximum(1, tokens))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = linear.SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, quality).

    A null text is empty and has the score of the bias. Repeated rows get equal scores, a row without a doc_id is
    in no fold. An empty table gives an empty one. A very long text is read in one piece. Without labels every
    score is 0.5. The model is fitted on at most ``sample`` labelled rows outside the held-out fold.
    """
    runtime.ship(docs.sparkSession)
    model = linear.fit(linear.sample(docs, labels, "quality", sample), train)
    return linear.decided(linear.score(docs, model, rate), THRESHOLD)
