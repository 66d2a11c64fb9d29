"""Every text operator on small hostile tables, against brute force where it is not a round trip."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import bpe, dac, decontam, license, minhash, multiset, quality, suffix, toxicity, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
GPT = public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")
SYLLABLES = ["tion", "er", "an", "the", "of", "é", "ñ", "Ä", "in", "and", "zu", "que", "3", "'s", "!"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("f", T.StringType()), T.StructField("n_words", T.IntegerType()), T.StructField("row", T.IntegerType()), T.StructField("n_chars", T.LongType())])


def sentence(rnd, n):
    return " ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def corpus():
    rnd = random.Random(4)
    shared = sentence(rnd, 120)
    long = sentence(rnd, 30_000)
    texts = [None, "", " \n\t ", "one", "One", "one two", "a" * 2000, "ab" * 900, "\x00\x1f　﻿", "🙂 é́  x", shared, shared, f"{sentence(rnd, 40)} {shared} {sentence(rnd, 30)}", f"{shared} mit license. Apache License, GENERAL public license", long, "line\n" * 300, "line\r\nline\n\nline", "x'll  's 'd\n 've 12 <|endoftext|>"]
    base = [sentence(rnd, 150) for _ in range(12)]
    for text in base:
        words = text.split(" ")
        texts.append(text)
        for edits in (1, 6, 14, 30):
            w = list(words)
            for _ in range(edits):
                w[rnd.randrange(len(w))] = sentence(rnd, 1)
            texts.append(" ".join(w))
    texts += [sentence(rnd, rnd.randint(1, 80)) for _ in range(40)]
    return [(i * 3 + 1, t, "clash", 7, i, None if t is None else len(t)) for i, t in enumerate(texts)] + [(None, "no id", "clash", 1, 1, 5), (1000, texts[20], "copy", 1, 1, 3), (1000, texts[20], "copy", 1, 1, 3)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def keyed(rows):
    return [(i, t or "") for i, t, *_ in rows]


def bag(pairs):
    return Counter(map(repr, pairs))


# --- 1 and 10: token ids ------------------------------------------------------------------------


def test_token_files_round_trip(spark, docs, empty, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(GPT)
    tokenizer.encode_special_tokens = True
    got = dac.round_trip(docs, GPT).orderBy("start").collect()
    want, start = [], 0
    for i, t in sorted((p for p in keyed(rows) if p[0] is not None), key=lambda p: (p[0], p[1])):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    assert [tuple(r)[:4] for r in got] == want
    assert all(r["n_checked"] == min(3, r["n_tokens"]) for r in got)
    assert dac.round_trip(empty, GPT).collect() == []


def test_token_ids_of_added_tokens_are_those_of_the_library(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    from tidelog.llm import queries

    own = ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "é<|endoftext|>  \n's <|endoftext| >", "<|endoftext|", "|endoftext|>", "a " * 3000 + "<|endoftext|>"]
    texts = [(i, t) for i, (_, t) in enumerate(keyed(rows) + [(0, t) for t in own])]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer, want, start = Tokenizer.from_file(GPT), [], 0
    assert tokenizer.encode(own[0], add_special_tokens=False).ids == [31373, 220, 50256, 995]
    for i, t in texts:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    got = queries.op1_token_ids(spark, str(tmp_path)).orderBy("start").collect()
    assert [tuple(r)[:4] for r in got] == want


def test_any_id_is_read_by_its_position(tmp_path):
    import numpy as np

    rnd = random.Random(1)
    for ids in ([], [0], [255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], [rnd.choice([3, 300, 70_000]) for _ in range(5000)]):
        file = tmp_path / "x.dac"
        file.write_bytes(dac.pack(np.array(ids, np.uint64), np.array([5, 9]), np.array([len(ids), 0])))
        with dac.runtime.RandomFile(str(file)) as source:
            reader = dac.Reader(source)
            assert reader.all().tolist() == ids
            assert [reader.access(p) for p in range(len(ids))] == ids
            assert [x.tolist() for x in reader.documents()] == [[5, 9], [0, len(ids), len(ids)]]
            with pytest.raises(IndexError):
                reader.access(len(ids))


def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})


def test_byte_bpe_is_that_of_the_library(docs, empty, rows):
    own = encoding()
    want = []
    for i, t in keyed(rows):
        ids = own.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert bag(tuple(r) for r in bpe.encode_digests(docs, MULTI).collect()) == bag(want)
    encoded = bpe.encode_documents(docs, MULTI)
    assert bag((r["doc_id"], r["text"]) for r in bpe.decode_ids(encoded, MULTI).collect()) == bag(keyed(rows))
    assert bpe.encode_digests(empty, MULTI).collect() == []


def test_transducer_on_random_bytes_and_streamed_decoding():
    rnd = random.Random(2)
    machine = bpe.Transducer(bpe.read_ranks(MULTI), limit=2000)
    tokens = list(machine.ranks)
    for k in range(3000):
        piece = bytes(rnd.choice(b"aabcdethn \xc3\xa9\x80") for _ in range(rnd.randint(1, 24))) if k % 2 else b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 3)))
        assert machine.encode(piece) == ([machine.ranks[piece]] if piece in machine.ranks else machine.merge(piece))
    text = "né 🙂 中文 " * 20
    decoder = bpe.StreamDecoder(machine.token)
    assert "".join([decoder.feed([machine.ranks[bytes([b])]]) for b in text.encode()] + [decoder.end()]) == text


def test_pieces_are_those_of_the_pattern():
    import pyarrow as pa
    import regex

    from tidelog.llm import textkit as K

    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab'sdtrelvm 12\n\t  é!?中　٣𝒳🙂\u0085\x1c") for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    pattern, got = regex.compile(public_tokenizers.PATTERN), []
    for s in K.slices(pa.array(texts), 500):
        cuts = K.pieces(s).tolist()
        got += [s.buf.tobytes()[a:b] for a, b in zip(cuts, cuts[1:])]
    assert got == [p.encode() for t in texts for p in pattern.findall(t)]


# --- 2: near duplicates ---------------------------------------------------------------------------


def shingles(text, width):
    w = SPACED.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_components(rows, width):
    ids = [r for r in rows if r[0] is not None]
    sets = [shingles(r[1], width) for r in ids]
    parent = list(range(len(ids)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)), key=lambda k: ids[k][0])
                parent[b] = a
    least = {}
    for i, r in enumerate(ids):
        least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least[top(i)]) for i, r in enumerate(ids)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, empty, rows, width):
    got = minhash.near_duplicates(docs, width).collect()
    assert bag((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == bag(brute_components(rows, width))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert minhash.near_duplicates(empty, width).collect() == []


def test_many_alone_in_a_bucket_are_compared_in_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(minhash, "FEW", 1)
    monkeypatch.setattr(minhash, "TOGETHER", 1)
    monkeypatch.setattr(minhash, "BLOCK", 300)
    got = minhash.near_duplicates(docs, 2).collect()
    monkeypatch.undo()
    assert bag(tuple(r) for r in got) == bag(tuple(r) for r in minhash.near_duplicates(docs, 2).collect())


def test_few_lots_of_a_class_that_many_are_compared_with(spark, monkeypatch):
    base = [f"word{k}" for k in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*base, f"only{i}"])) for i in range(12)], "doc_id long, text string")
    monkeypatch.setattr(minhash, "TOGETHER", 1)
    monkeypatch.setattr(minhash, "LOTS", 2)
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs, 2).collect()} == {(i, 0) for i in range(12)}


def test_rows_that_share_the_smallest_doc_id_leave_one(spark):
    same, other = " ".join(f"word{k}" for k in range(40)), " ".join(f"else{k}" for k in range(40))
    docs = spark.createDataFrame([(9, other), (5, same), (7, same), (5, same), (5, same), (7, same + " more")], "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.deduplicated(docs).collect()) == [(5, same), (9, other)]


def test_a_column_called_as_the_readers_own(spark, rows, tmp_path):
    named = spark.createDataFrame(rows, SCHEMA).where("doc_id IS NOT NULL").withColumn("_metadata", F.struct(F.lit(7).alias("row_index")))
    named.write.parquet(str(tmp_path / "d"))
    plain = spark.read.parquet(str(tmp_path / "d"))
    want = bag(tuple(r) for r in suffix.repeats(named.drop("_metadata")).collect())
    for d in (plain, named):
        assert bag(tuple(r) for r in suffix.repeats(d).collect()) == want
        assert suffix.without_repeats(d).columns == named.columns
        assert minhash.deduplicated(d).columns == named.columns
        assert decontam.decontaminated(d, spark.createDataFrame([("x", "nothing of this")], "item_id string, text string")).columns == named.columns


def test_a_lost_sidecar_file_is_an_error(spark, tmp_path):
    from tidelog.llm import places

    side = places.Sidecar.write(spark.createDataFrame([(5, 1, 10), (5, 20000, 11), (9, 0, 12)], "f long, r long, x long"), "lost")
    find = side.reader()
    assert find(5, np.array([0, 1, 20000]))[1].tolist() == [[10], [11]] and find(6, np.array([0]))[1].tolist() == []
    Path(side._file(9, 0).removeprefix("file://")).unlink()
    with pytest.raises(places.Lost):
        side.reader()(9, np.array([0]))


def test_outliers_of_a_large_group(spark, tmp_path):
    """The smallest ids are the most edited texts, so that stars round the first class of a bucket miss links."""
    rnd = random.Random(12)
    base = sentence(rnd, 160).split(" ")
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(max(0, 34 - i // 2)):
            w[rnd.randrange(len(w))] = sentence(rnd, 1)
        rows.append((i, " ".join(w)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = minhash.near_duplicates(spark.read.parquet(str(tmp_path / "d")), 2).collect()
    want = brute_components(rows, 2)
    assert 1 < len({c for *_, c in want}) < 60
    assert bag((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == bag(want)


def test_one_of_each_group_stays(docs, empty, rows):
    kept = minhash.deduplicated(docs)
    assert kept.schema.names == docs.schema.names
    groups = {}
    for (i, n, c) in brute_components(rows, 5):
        if n:
            groups.setdefault(c, []).append(i)
    nothing = [i for i, n, _ in brute_components(rows, 5) if not n] + [None]
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == sorted([min(g) for g in groups.values()] + [i or 0 for i in nothing])
    assert minhash.deduplicated(empty).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(101, 100)], "a long, b long")
    got = {r["id"]: r["component"] for r in minhash.components(links).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


# --- 3: fingerprints ------------------------------------------------------------------------------


def test_edited_fingerprints(docs, empty, rows):
    ordered = sorted(((i, t) for i, t in keyed(rows) if i is not None), key=lambda p: (p[0], p[1].encode()))
    want = []
    for k, (i, t) in enumerate(ordered):
        half = len(t) // 2
        edited = t[: len(t) - half] + ordered[(k + 1) % len(ordered)][1][:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    got = multiset.edited_fingerprints(docs).collect()
    assert bag((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == bag(want)
    by_text = {}
    texts = dict(ordered)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert by_text.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert len(set(by_text.values())) == len(by_text)
    assert multiset.edited_fingerprints(empty).collect() == []
    assert len(multiset.edited_fingerprints(docs.limit(1)).collect()) <= 1


def test_fingerprints_add_and_subtract(spark):
    parts = ["first part, with words.", "second one; longer than that", "third"]
    df = spark.createDataFrame([("\n".join(parts), "\n".join(reversed(parts)), "\n".join(parts[:2]), parts[2])], "a string, b string, c string, d string")
    for c in "abcd":
        df = multiset.with_fingerprint(df, c, f"f{c}")
    r = df.select("fa", "fb", multiset.insert(F.col("fc"), F.col("fd")).alias("sum"), multiset.delete(F.col("fa"), F.col("fd")).alias("rest"), "fc").head()
    assert r["fa"] == r["fb"] == r["sum"] and r["rest"] == r["fc"] and r["fa"] != r["fc"]


# --- 4: licences ----------------------------------------------------------------------------------


def test_license_phrases_are_in_the_automaton():
    import pyarrow as pa

    from tidelog.llm import textkit as K

    scanner, rnd = license.Scanner(), random.Random(9)
    assert {len(license.TEMPLATES) + t for t in range(len(license.PHRASES))} <= {t for places in scanner._automaton.places for t in places}
    words = ["mit", "license", "apache", "general", "public", "gnu", "under", "the", "version", "other"]
    texts = [" ".join(rnd.choice(words[: rnd.randint(2, 10)]) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + [t for _, t in license.TEMPLATES]
    got = [r for s in K.slices(pa.array(texts), 2000) for r in scanner.scan(s)]
    for text, (n, base, first, last, labels, _) in zip(texts, got, strict=True):
        w = WORD.findall(text.translate(LOW))
        places = [(k, label) for p, label in license.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in places]
        assert (n, base, first, last, labels) == (len(w), len(places), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places}))


def test_license_places(docs, empty, rows):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = []
    for i, t in keyed(rows):
        w = WORD.findall(t.translate(LOW))
        places = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in places]
        want.append((i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    got = license.scan_licenses(docs).collect()
    assert bag(tuple(r)[:6] for r in got) == bag(want)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert license.scan_licenses(empty).collect() == []


def test_license_spans(spark):
    mit = license.TEMPLATES[0][1]
    words = mit.split(" ")
    cut = " ".join(words[:40] + ["changed", "here"] + words[43:])
    texts = ["Code below.\n// " + mit.replace(" ", "\n * "), cut, " ".join(words[:20]), "permission to sell all copies of the software is hereby granted to any person", license.TEMPLATES[4][1] + " " + license.TEMPLATES[7][1], "licensed under cc by nc 4 0"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["labels"] for r in license.scan_licenses(frame).orderBy("doc_id").collect()]
    assert got == ["mit", "mit", "", "", "gpl,isc", "cc-by-nc"]


def test_automaton_gives_matching_statistics():
    rnd = random.Random(5)
    templates = [[rnd.randrange(4) for _ in range(30)] for _ in range(3)]
    machine = license.Automaton(templates)
    text = [rnd.randrange(5) for _ in range(300)]
    longest = [max(n for n in range(31) if n == 0 or (k + 1 - n >= 0 and any(t[i : i + n] == text[k + 1 - n : k + 1] for t in templates for i in range(31 - n)))) for k in range(len(text))]
    ends = {end - 1: (n, state) for end, n, state in machine.matches(text, 1)}
    assert ends == {k: (longest[k], ends[k][1]) for k in ends}
    assert set(ends) == {k for k in range(len(text)) if longest[k] and (k + 1 == len(text) or longest[k + 1] <= longest[k])}
    for end, (n, state) in ends.items():
        run = text[end + 1 - n : end + 1]
        for t in range(3):
            assert machine.places[state].get(t, []) == [k for k in range(n, 31) if templates[t][k - n : k] == run]


def heaviest(matches, reach):
    """The weight of the heaviest chain, over all subsets."""
    most = 0
    for k in range(1, 1 << len(matches)):
        some = sorted(m for i, m in enumerate(matches) if k >> i & 1)
        weight, good = some[0][1], True
        for (a, n, p), (b, m, q) in zip(some, some[1:]):
            gain = m - max(0, a + n - b, p + n - q)
            good &= a < b and p < q and b - a <= reach and gain > 0
            weight += gain
        most = max(most, weight if good else 0)
    return most


def test_chains_are_the_heaviest():
    rnd = random.Random(6)
    for _ in range(300):
        matches = [(rnd.randrange(30), rnd.randint(1, 6), rnd.randrange(20)) for _ in range(rnd.randint(1, 9))]
        found = license.chains(matches, reach=12)
        assert found[0][2] == heaviest(matches, 12)
        assert all(z <= x or y <= a for k, (a, z, _) in enumerate(found) for x, y, _ in found[:k])
    assert license.chains([], 5) == []


def test_license_labels_and_scores_by_brute_force(spark):
    rnd = random.Random(7)
    known = sorted({w for _, t in license.TEMPLATES for w in WORD.findall(t.translate(LOW))})
    texts = []
    for _ in range(40):
        words = []
        for _ in range(rnd.randint(1, 2)):
            template = WORD.findall(rnd.choice(license.TEMPLATES)[1].translate(LOW))
            for _ in range(rnd.randint(0, 2)):
                at = rnd.randrange(len(template) + 1)
                template[at : at + rnd.randint(0, 8)] = [rnd.choice([*known, "zzz"]) for _ in range(rnd.randint(0, 8))]
            words += template + ["zzz"] * rnd.randint(0, 3)
        texts.append(" ".join(words))
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    got = {r["doc_id"]: r for r in license.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    templates = [(label, WORD.findall(t.translate(LOW))) for label, t in license.TEMPLATES]
    runs = {tuple(t[a:z]) for _, t in [*templates, *((x, p.split()) for p, x in phrases.items())] for a in range(len(t)) for z in range(a + 1, len(t) + 1)}
    for i, text in enumerate(texts):
        w, labels, score = text.split(" "), set(), 0.0
        longest = [max((n for n in range(1, k + 2) if tuple(w[k + 1 - n : k + 1]) in runs), default=0) for k in range(len(w))]
        ends = [(k, n) for k, n in enumerate(longest) if n and (k + 1 == len(w) or longest[k + 1] <= n)]
        for label, t in templates:
            least = min(license.LONG_MATCH, len(t))
            own = [(k + 1 - n, n, p) for k, n in ends if n >= least for p in range(len(t) - n + 1) if t[p : p + n] == w[k + 1 - n : k + 1]]
            found = [c for c in license.chains(own, license.APART * len(t)) if c[2] >= license.COVERED * len(t)]
            if found:
                labels.add(label)
                score = max(score, *(min(1.0, c[2] / len(t)) for c in found), 0.0)
        base = {label for p, label in phrases.items() if f" {p} " in f" {text} "}
        assert got[i]["labels"] == ",".join(sorted(labels | base)) and got[i]["score"] == pytest.approx(1.0 if base else score), i


def test_a_stray_match_loses_no_license(spark):
    words = license.TEMPLATES[0][1].split(" ")
    text = " ".join(words[:50] + words[2:10] + words[50:])
    got = license.scan_licenses(spark.createDataFrame([(1, text), (2, text + " and " + text)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == ["mit", "mit"] and got[0]["score"] > 0.95 and len(got[1]["spans"]) == 2


# --- 5: repeated passages -------------------------------------------------------------------------


def brute_repeats(rows, length):
    texts = [t.encode() for _, t in keyed(rows)]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(keyed(rows), texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def test_repeats(docs, empty, rows):
    assert bag(tuple(r) for r in suffix.repeats(docs).collect()) == bag(brute_repeats(rows, 400))
    assert suffix.repeats(empty).collect() == []
    stored_copy = docs.where("doc_id IS NOT NULL").orderBy("doc_id")  # no plain scan: it is stored first
    assert suffix.repeats(stored_copy).count() == docs.where("doc_id IS NOT NULL").count()


def test_cut_texts_keep_rows_and_columns(docs, rows):
    cut = suffix.without_repeats(docs)
    assert cut.schema.names == docs.schema.names and cut.count() == docs.count()
    removed = {i: n for i, _, n, *_ in brute_repeats(rows, 400)}
    texts = dict(keyed(rows))
    for r in cut.where("doc_id IS NOT NULL").collect():
        if not removed[r["doc_id"]]:
            assert (r["text"] or "") == texts[r["doc_id"]]
        else:
            assert len(r["text"].encode()) <= len(texts[r["doc_id"]].encode()) - removed[r["doc_id"]] and r["n_chars"] == len(r["text"])
    assert cut.where("text IS NULL").count() == 1


# --- 6: archives ----------------------------------------------------------------------------------


def test_archives(spark, docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x/ y").alias("url"), F.col("text").alias("html"), F.lit(1).alias("key"), F.lit(2).alias("original"))
    got = warc.archive(pages).collect()
    payloads = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect() if r["page_id"] is not None]
    last = {}
    for i, p in payloads:
        last[p] = max(last.get(p, i), i)
    want = [(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if last[p] == i else "revisit", None if last[p] == i else last[p], True) for i, p in payloads]
    assert bag(tuple(r) for r in got) == bag(want)
    assert warc.archive(pages.limit(0)).collect() == []


def test_bundle_gives_single_records(tmp_path):
    import zstandard

    writer = warc.BundleWriter(frame_bytes=500)
    records = {i: warc.make_record(i, None, b"x" * (i * 7), "D", 99 if i % 5 == 0 else None) for i in range(40)}
    for i, r in records.items():
        writer.add(i, r)
    file = tmp_path / "b.warc.zst"
    file.write_bytes(writer.finish())
    with warc.runtime.RandomFile(str(file)) as source:
        reader = warc.BundleReader(source)
        assert {i: reader.record(i) for i in records} == records and dict(reader.records()) == records
        with pytest.raises(KeyError):
            reader.record(77)
    with file.open("rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(records.values())
    fields, http, payload = warc.parse_record(records[5])
    assert fields["WARC-Type"] == "revisit" and payload == b"" and http["Content-Length"] == "35"


# --- 7 and 8: classifiers ---------------------------------------------------------------------------


def labelled(spark, n=900):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        bad, toxic = rnd.random() < 0.3, rnd.random() < 0.3
        words = sentence(rnd, rnd.randint(5, 60)).split(" ")
        if toxic:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(["idiot", "moronic", "scum"])
        if bad:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("target", ["quality", "toxic"])
def test_classifiers_hold_out(spark, docs, empty, target):
    texts, labels = labelled(spark)
    score, threshold = (quality.score_quality, 0.5) if target == "quality" else (toxicity.score_toxicity, 0.7)
    got = score(texts, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert [r["held_out"] for r in got] == [zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in got]
    assert sum(r["predicted"] == r[target] for r in held) >= 0.95 * len(held)
    assert all(r["predicted"] == int(r["score"] >= threshold) and 0 <= r["score"] <= 1 for r in got)
    hostile = score(docs, labels.withColumn("doc_id", F.col("doc_id") % 40)).collect()
    assert len(hostile) == docs.count() and all(r["score"] is not None for r in hostile)
    assert [r["score"] for r in score(docs, labels.limit(0)).collect()] == [0.5] * docs.count()
    assert score(empty, labels).collect() == []


def test_toxic_documents_go(spark):
    texts, labels = labelled(spark)
    kept = toxicity.without_toxic(texts.withColumn("weights", F.lit(1)), labels)
    got = {r["doc_id"] for r in kept.collect()}
    rejected = {r["doc_id"] for r in toxicity.score_toxicity(texts, labels).where("predicted = 1").collect()}
    assert kept.schema.names == ["doc_id", "text", "weights"] and got == {r["doc_id"] for r in texts.collect()} - rejected


# --- 9: contamination -------------------------------------------------------------------------------


def brute_contamination(rows, items):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOW))
        for k in range(len(w) - min(13, len(w)) + 1) if w else ():
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(item))
    out = []
    for i, t in keyed(rows):
        w = WORD.findall(t.translate(LOW))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= x
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def items_of(rows):
    texts = [t for _, t in keyed(rows)]
    return [(1, texts[10][50:400]), (2, " ".join(texts[18].split(" ")[20:45])), (10, "One"), (3, None), (4, "!!"), (5, texts[10][50:400]), (6, "line line line"), (7, sentence(random.Random(9), 60)), (8, "apache license"), (9, texts[14][70_000:70_200])]


@pytest.mark.parametrize("bound", [decontam.BOUND, 3])
def test_contamination(spark, docs, empty, rows, bound):
    items = items_of(rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert bag(tuple(r) for r in decontam.contamination(docs, benchmark, bound).collect()) == bag(brute_contamination(rows, items))
    assert decontam.contamination(empty, benchmark, bound).collect() == []
    assert all(r["n_hit"] == 0 for r in decontam.contamination(docs, benchmark.limit(0), bound).collect())


def test_decontaminated_texts(spark, docs, rows):
    items = items_of(rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = brute_contamination(rows, items)
    left = decontam.decontaminated(docs, benchmark)
    got = left.collect()
    assert left.schema.names == docs.schema.names and len(got) == sum(not f[5] for f in found)
    hits = {f[0]: f for f in found}
    texts = dict(keyed(rows))
    assert any(0 < f[2] and not f[5] for f in found)
    for r in got:
        f = hits[r["doc_id"]]
        if f[2] == 0:
            assert (r["text"] or "") == texts[r["doc_id"]] or r["doc_id"] == 1000
        else:
            assert len(WORD.findall(r["text"].translate(LOW))) == f[1] - f[2] and r["n_chars"] == len(r["text"])
