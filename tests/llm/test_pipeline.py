"""The pipeline on the small tables and planted rows: each stage's rows, texts included, against a brute-force version.

Every stage is held against brute force over what it was given. The classifier's weights are learnt by a plain version too.
"""

import hashlib
import importlib.util
import math
import random
import shutil
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import test_small as small

from tidelog.llm import linear, suffix, toxicity
from tidelog.llm import textkit as K

DATA = Path("/root/testdata/sf0.001")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BASE, MASK = K._BASE, (1 << 64) - 1


# --- toxicity, plainly ------------------------------------------------------------------------------


def brute_features(text):
    """The features that a text has: the hashes of its runs of three to six bytes."""
    plain = (" " + "".join(w + " " for w in small.WORD.findall((text or "").translate(small.LOW)))).encode()
    grams = {plain[i : i + n] for n in (3, 4, 5, 6) for i in range(len(plain) - n + 1)}
    sums = [(sum(int(K.RAW_VALUES[b]) * pow(BASE, j, 1 << 64) for j, b in enumerate(g)) + len(g)) & MASK for g in grams]
    return {int(h) >> (64 - toxicity.BITS) for h in K.mix(np.array(sums, np.uint64))}


def brute_ratios(features, labels):
    having = [Counter(f for fs, y in zip(features, labels, strict=True) if y == c for f in fs) for c in (0, 1)]
    n = [max(1, labels.count(c)) for c in (0, 1)]
    out = {}
    for f in having[0].keys() | having[1].keys():
        q, p = having[0][f], having[1][f]
        ratio = math.log((p + 1) / (n[1] + 2)) - math.log((q + 1) / (n[0] + 2))
        if p + q >= toxicity.LEAST and abs(ratio) >= 3 / math.sqrt(min(p, q) + 1):
            out[f] = ratio
    return out


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-40, min(40, x))))


def brute_learnt(features, labels, ratios, penalty):
    """FTRL over dictionaries: {feature: weight times ratio}, the bias under None."""
    z, squares = Counter(), Counter()
    n = {c: max(1, labels.count(c)) if c else max(1, len(labels) - max(1, labels.count(1))) for c in (0, 1)}

    def weight(f):
        return -math.copysign(max(abs(z[f]) - penalty, 0), z[f]) / ((1 + math.sqrt(squares[f])) / 0.1 + 0.1)

    order = np.random.default_rng(8)
    for _ in range(toxicity.EPOCHS):
        for i in order.permutation(len(labels)):
            x = {f: ratios[f] for f in features[i] if f in ratios} | {None: 1.0}
            w = {f: weight(f) for f in x}
            wrong = len(labels) / 2 / n[labels[i]] * (sigmoid(sum(w[f] * x[f] for f in x)) - labels[i])
            for f in x:
                g = wrong * x[f]
                z[f] += g - (math.sqrt(squares[f] + g * g) - math.sqrt(squares[f])) / 0.1 * w[f]
                squares[f] += g * g
    return {f: weight(f) * ratios.get(f, 1.0) for f in [*ratios, None]}


def brute_score(features, weights):
    return sigmoid(weights[None] + sum(weights.get(f, 0) for f in features))


def brute_trained(texts, labels):
    features = [brute_features(t) for t in texts]
    outer = [i for i in range(len(labels)) if i % 4 != 3]
    inner = [i for i in range(len(labels)) if i % 4 == 3]
    part, marks = [features[i] for i in outer], [labels[i] for i in outer]
    ratios = brute_ratios(part, marks)

    def wrong(penalty):
        m = brute_learnt(part, marks, ratios, penalty)
        return sum((brute_score(features[i], m) >= 0.7) != (labels[i] == 1) for i in inner)

    return brute_learnt(features, labels, brute_ratios(features, labels), min(toxicity.PENALTIES, key=lambda p: (wrong(p), -p)))


def test_toxicity_is_learnt_as_by_a_plain_version(spark):
    texts, labels = small.labelled(spark, 240)
    model = toxicity.fit(texts, labels)
    rows = sorted((r["doc_id"], r["text"], r["label"]) for r in linear.sample(texts, labels, "toxic").collect())
    want = brute_trained([t for _, t, _ in rows], [y for *_, y in rows])
    assert model.bias == pytest.approx(want[None], abs=1e-4)
    got = {int(f): float(model.weights[f]) for f in np.flatnonzero(model.weights)}
    assert got.keys() == {f for f, w in want.items() if f is not None and w}
    assert len(got) > 20 and all(w == pytest.approx(want[f], abs=1e-4) for f, w in got.items())


def test_features_of_hostile_texts(rows):
    texts = [t for _, t in small.keyed(rows) if len(t) < 5000]
    seen = set()
    for s in K.slices(pa.array(texts, pa.string()), 4000):
        feature, row = toxicity.present(s)
        for i in range(s.hi - s.lo):
            assert set(feature[row == i].tolist()) == brute_features(texts[s.lo + i])
            seen.add(s.lo + i)
    assert seen == set(range(len(texts)))


# --- each stage, plainly ----------------------------------------------------------------------------


def brute_toxicity(docs, tables):
    spark, frame, labels = tables["spark"], tables["frame"], tables["labels"]
    model = toxicity.fit(frame, labels)
    weights = {int(f): float(model.weights[f]) for f in np.flatnonzero(model.weights)} | {None: model.bias}
    return [r for r in docs if brute_score(brute_features(r[1]), weights) < 0.7]


def brute_near_duplicates(docs, _):
    groups = {i: (n, c) for i, n, c in small.brute_components([r[:2] for r in docs], 5)}
    return [r for r in docs if not groups[r[0]][0] or groups[r[0]][1] == r[0]]


def brute_cut_texts(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for text, t in zip(texts, raw, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        at, kept = 0, []
        for c in text or "":
            n = len(c.encode())
            if not any(gone[at : at + n]):
                kept.append(c)
            at += n
        out.append(None if text is None else "".join(kept))
    return out


def brute_suffix_dedup(docs, _):
    cut = brute_cut_texts([r[1] for r in docs], 400)
    return [(r[0], t, *r[2:4], r[4] if t == r[1] else len(t)) for r, t in zip(docs, cut, strict=True)]


def brute_decontamination(docs, tables):
    windows = set()
    for text in tables["items"]:
        w = small.WORD.findall((text or "").translate(small.LOW))
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    sizes, out = {len(w) for w in windows}, []
    for r in docs:
        found = list(small.WORD.finditer((r[1] or "").translate(small.LOW)))
        words, hit = [m.group() for m in found], set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if hit and 20 * len(hit) >= len(words):
            continue
        gone = bytearray(len(r[1] or ""))
        for k in hit:
            end = found[k + 1].start() if k + 1 in hit else found[k].end()
            gone[found[k].start() : end] = b"\x01" * (end - found[k].start())
        text = r[1] and "".join(c for c, g in zip(r[1], gone, strict=True) if not g)
        out.append((r[0], text, *r[2:4], len(text) if hit else r[4]))
    return out


def brute_byte_bpe(docs, _):
    own, out = small.encoding(), []
    for r in docs:
        ids = own.encode_ordinary(r[1] or "")
        out.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest(), ids))
    return out


BRUTE = {"toxicity": brute_toxicity, "near_duplicates": brute_near_duplicates, "suffix_dedup": brute_suffix_dedup, "decontamination": brute_decontamination, "byte_bpe": brute_byte_bpe}


@pytest.fixture(scope="module")
def rows():
    return small.corpus()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The small tables with more rows: null and empty texts, a hot group of copies, a shared passage, benchmark words."""
    rnd, root = random.Random(31), tmp_path_factory.mktemp("sf")
    for name in ("labels", "benchmark"):
        shutil.copy(DATA / f"{name}.parquet", root / f"{name}.parquet")
    docs = spark.read.parquet(str(DATA / "documents.parquet")).select(COLUMNS)
    item = max((r["text"] or "" for r in spark.read.parquet(str(root / "benchmark.parquet")).collect()), key=len)
    passage, copy = small.sentence(rnd, 130), small.sentence(rnd, 60)
    texts = [None, "", " \n", *[copy] * 40, *(f"{small.sentence(rnd, 50)} {passage} {small.sentence(rnd, 60)}" for _ in range(5)), f"{small.sentence(rnd, 20)} {item}", f"{small.sentence(rnd, 4000)} {item}, {small.sentence(rnd, 400)}"]
    first = docs.agg({"doc_id": "max"}).head()[0] + 1
    more = spark.createDataFrame([(first + k, t, "en", "planted", None if t is None else len(t)) for k, t in enumerate(texts)], docs.schema)
    docs.union(more).repartition(3).write.parquet(str(root / "documents.parquet"))
    return str(root)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_every_stage_by_brute_force(spark, sf_dir, tmp_path):
    path = Path(__file__).resolve().parents[2] / "corpus_pipeline.py"
    spec = importlib.util.spec_from_file_location("corpus_pipeline", path)
    pipeline = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(pipeline)
    assert [name for name, _ in pipeline.STAGES] == list(BRUTE)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = {"spark": spark, "labels": spark.read.parquet(f"{sf_dir}/labels.parquet"), "items": [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]}
    given = sorted((tuple(r) for r in docs.collect()), key=lambda r: r[0])
    for k, (name, stage) in enumerate(pipeline.STAGES):
        want = BRUTE[name](given, tables | {"frame": docs})
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = sorted((tuple(r) for r in docs.collect()), key=lambda r: r[0])
        assert k + 1 == len(BRUTE) or docs.columns == COLUMNS
        assert got == sorted(want, key=lambda r: r[0]), name
        assert k + 1 == len(BRUTE) or got != given, f"{name} changed nothing here"
        given = got
    whole = sorted((tuple(r) for r in pipeline.run(spark, sf_dir).collect()), key=lambda r: r[0])
    assert whole == given and whole


def test_bytes_on_both_sides_of_a_cut_make_no_new_character(spark, tmp_path):
    """The passage begins with the last byte of a character and ends with the first byte of another."""
    passage = "p" * 7 + " the passage that stands in both texts" * 12
    texts = [f"x©{passage}éz", f"yé{passage}ñw"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = suffix.without_repeats(spark.read.parquet(str(tmp_path / "d"))).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == brute_cut_texts(texts, 400) == ["xz", "yw"]
