"""Near duplicates: MinHash bands for candidates, odd sketches to verify them first, full sets to confirm links.

A document's set is that of its distinct runs of ``width`` words (with fewer words: the whole sequence; without
words: empty), by 64-bit hashes. Documents with equal sets form a class and one of them stands for it, so copies are
never compared. Of a class's set, PERMUTATIONS minima are taken, and ROWS of them make a band: sets of similarity s share
a band with probability 1 - (1 - s**ROWS)**BANDS, at 0.8 all but one in 2e7.

An odd sketch keeps, for each place of a bitmap, whether an odd number of the minima fell there. The exclusive or of two
sketches holds just the minima that differ, and its number of ones tells how many those are, most precisely where they
are few. Candidates with more than FAR ones are far below the threshold (a pair at the threshold has 93 on average, with a deviation of 14) and are dropped; all others are confirmed on full sets.

Within a bucket every class is compared with the bucket's first class, not with all. What is linked so is joined into
components; then, in buckets with classes of several components, those outside the largest are compared with the
other components (all their classes, in blocks) and those that are still alone with each other (pair by pair where a
bucket has FEW of them, else in blocks). So a link is lost only if its ends are in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from . import textkit as K
from .places import Sidecar, at_rest, files_of, place, scan, scan_beside

#: Minima of a set; the bands use the first BANDS * ROWS of them, the sketch all.
PERMUTATIONS = 256
ROWS = 4
BANDS = 32
#: Words of 64 bits in an odd sketch.
SKETCH = 16
FAR = 160
#: Similarity of a link, in hundredths.
PERCENT = 80
WIDTH = 5

_ODD = K.mix(np.arange(1, PERMUTATIONS + 1, dtype=K.U64) * K.U64(0x9E6C63D0876A9F35)) | K.U64(1)
_SALT = K.mix(np.arange(1, PERMUTATIONS + 1, dtype=K.U64) * K.U64(0xC2B2AE3D27D4EB4F))


def shingle_sets(s: K.Slice, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of each row one after the other, where each row begins, with the end)."""
    n = s.hi - s.lo
    a, b = K.spans(s, K.SPACED)
    word = K.span_hash(K.prefix_hash(s.buf, K.LOWER_VALUES), a, b)
    begins = np.searchsorted(a, s.offsets)
    counts = np.diff(begins)
    sizes = np.where(counts == 0, 0, np.maximum(1, counts - width + 1))
    starts = np.repeat(begins[:-1], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows = np.repeat(np.arange(n), sizes)
    length = np.minimum(counts, width)[rows]
    h = length.astype(K.U64)
    for k in range(width):
        more = k < length
        h = np.where(more, h * K.U64(0x9FB21C651E98DF25) + word[np.minimum(starts + k, len(word) - 1)] if len(word) else h, h)
    h = K.mix(h)
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    h, rows = h[keep], rows[keep]
    return h, np.searchsorted(rows, np.arange(n + 1))


def signatures(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketches) of non-empty sets, a row for each."""
    n = len(at) - 1
    minima = np.empty((n, PERMUTATIONS), K.U64)
    for k in range(PERMUTATIONS):
        v = (sets ^ _SALT[k]) * _ODD[k]
        minima[:, k] = np.minimum.reduceat(v, at[:-1])
    bands = np.empty((n, BANDS), K.U64)
    for j in range(BANDS):
        h = np.full(n, j + 1, K.U64)
        for k in range(j * ROWS, (j + 1) * ROWS):
            h = K.mix(h * K.U64(3) + minima[:, k])
        bands[:, j] = h
    sketch = np.zeros((n, SKETCH), K.U64)
    every = np.arange(n)
    for k in range(PERMUTATIONS):
        spot = K.mix(minima[:, k] + _SALT[k]) >> K.U64(64 - (64 * SKETCH).bit_length() + 1)
        sketch[every, (spot >> K.U64(6)).astype(np.int64)] ^= K.U64(1) << (spot & K.U64(63))
    return bands, sketch


_SETS = f"f long, r long, n long, name1 long, name2 long, bands array<long>, {', '.join(f's{k} long' for k in range(SKETCH))}, doc_id long"


def set_table(docs: DataFrame, width: int) -> DataFrame:
    """For each row of ``docs``: its place, the size of its set, the set's name (two hashes), bands, sketch and doc_id."""
    signed = lambda x: np.ascontiguousarray(x).view(np.int64)

    def work(s: K.Slice, f: int, numbers: np.ndarray) -> dict:
        sets, at = shingle_sets(s, width)
        size = np.diff(at)
        full = size > 0
        names = []
        for salt in (1, 2):
            sums = np.concatenate([np.zeros(1, K.U64), np.cumsum(K.mix(sets * K.U64(2) + K.U64(salt)), dtype=K.U64)])
            names.append(signed(sums[at[1:]] - sums[at[:-1]]))
        bands, sketch = np.zeros((len(size), BANDS), K.U64), np.zeros((len(size), SKETCH), K.U64)
        rows = np.flatnonzero(full)
        for k in range(0, len(rows), 2048):
            some = rows[k : k + 2048]
            low, high = at[some[0]], at[some[-1] + 1]
            bands[some], sketch[some] = signatures(sets[low:high], np.append(at[some], high) - low)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * BANDS, pa.int32()), pa.array(signed(bands).ravel()))
        return {"f": np.full(len(size), f), "r": numbers, "n": size, "name1": names[0], "name2": names[1], "bands": listed} | {f"s{k}": signed(sketch[:, k]) for k in range(SKETCH)}

    return scan(docs, work, _SETS, also=("doc_id",))


def _near(a: str, b: str):
    ones = F.lit(0)
    for k in range(SKETCH):
        ones = ones + F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}")))
    return ones <= FAR


#: Pairs with the same b that are confirmed by one task, as long as these make no more than LOTS lots.
TOGETHER = 256
LOTS = 1024


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """The ``pairs`` (a, b) of classes whose full sets are similar enough.

    One scan emits the set of each a, and that of each b once for every TOGETHER of its pairs, LOTS times at most; they
    meet in lots of (b, lot), where b's set comes first. So a b that very many are compared with is dealt over many
    tasks, its set is written a bounded number of times, and texts and sets of other rows stay where they are.
    """
    spark = docs.sparkSession
    lots = runtime.stored(pairs.groupBy("b").agg(F.least(F.ceil(F.count("*") / TOGETHER), F.lit(LOTS)).alias("lots")), "pair-lots")
    asked = pairs.join(lots, "b").select(F.col("a").alias("own"), "b", F.pmod(F.xxhash64("a"), "lots").alias("lot"), F.lit(1).alias("asks"))
    first = lots.select(F.col("b").alias("own"), "b", F.explode(F.expr("sequence(0, lots - 1)")).alias("lot"), F.lit(0).alias("asks"))
    spots = classes.select(F.col("id").alias("own"), "f", "r")
    side = Sidecar.write(asked.unionByName(first).join(spots, "own").select("f", "r", "own", "b", "lot", "asks"), "pairs")

    def work(s: K.Slice, f: int, numbers: np.ndarray, row: np.ndarray, found: np.ndarray) -> dict:
        sets, at = shingle_sets(s, width)
        return {"own": found[:, 0], "b": found[:, 1], "lot": found[:, 2], "asks": found[:, 3], "members": pa.array([sets[at[i] : at[i + 1]].tobytes() for i in row], pa.binary())}

    sets = scan_beside(docs, side, work, "own long, b long, lot long, asks long, members binary")
    dealt = sets.repartition(runtime.shuffle_partitions(spark), "b", "lot").sortWithinPartitions("b", "lot", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, v = None, np.zeros(0, K.U64)
        for batch in batches:
            own, b, lot, asks = (c.to_pylist() for c in batch.columns[:4])
            linked = []
            for i, members in enumerate(batch.column(4)):
                u = np.frombuffer(members.as_buffer(), K.U64)
                if not asks[i]:
                    at, v = (b[i], lot[i]), u.copy()
                    continue
                if at != (b[i], lot[i]):
                    raise AssertionError(f"the set of class {b[i]} is missing")
                same = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
                if 100 * same >= PERCENT * (len(u) + len(v) - same):
                    linked.append((own[i], b[i]))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in linked], pa.int64()), "b": pa.array([y for _, y in linked], pa.int64())})

    return dealt.select("own", "b", "lot", "asks", "members").mapInArrow(runtime.tidy(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ends of ``links`` (a, b): the smallest id that can be reached.

    Labels take the least of their neighbours' and then that of their own label's node, so a chain is
    walked in a logarithmic number of rounds in the usual case; each round is a stored table.
    """
    edges = runtime.stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = runtime.stored(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        around = edges.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        lower = runtime.stored(labels.join(around, "id").select("id", F.least("component", "m").alias("component"), F.col("component").alias("was")), "lower-labels")
        jumped = lower.join(lower.select(F.col("id").alias("component"), F.col("component").alias("next")), "component", "left").select("id", F.least("component", F.coalesce("next", "component")).alias("component"), "was")
        stored = runtime.stored(jumped, "labels")
        labels = stored.select("id", "component")
        if stored.where("component < was").isEmpty():
            return labels


#: Classes of a bucket that are compared pair by pair; more are compared in blocks.
FEW = 64


def linked_classes(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(id, component) of the classes that have links to other classes.

    Sides of joins that sum up a key are stored first: then a key that holds very many rows of the other side is split
    over tasks by Spark when it runs.
    """
    sketches = classes.select("id", F.struct(*(f"s{k}" for k in range(SKETCH))).alias("sketch"))
    # The band's number is part of its key.
    members = classes.select("id", F.explode("bands").alias("key"))
    shared = runtime.stored(members.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first"), "shared-keys")
    buckets = runtime.stored(members.join(shared, "key"), "buckets")

    def sifted(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a")
        return with_a.join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b").where(_near("sa", "sb")).select("a", "b")

    tried = runtime.stored(sifted(buckets.where("id > first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()), "candidates")
    links = runtime.stored(_confirmed(docs, classes, tried, width), "links")
    labels = components(links)

    sized = runtime.stored(labels.groupBy("component").agg(F.count("*").alias("size")), "component-sizes")
    labels = runtime.stored(labels.join(sized, "component").select("id", "component", "size"), "sized-labels")

    # Buckets whose classes are in several components: every class outside the largest one is still to be compared.
    labelled = buckets.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"), F.coalesce("size", F.lit(1)).alias("size"))
    held = runtime.stored(labelled.groupBy("key", "component", "size").agg(F.count("*").alias("n")), "held")
    mixed = runtime.stored(held.groupBy("key").agg(F.count("*").alias("several"), F.max(F.struct("n", "component")).alias("most"), F.sum((F.col("size") == 1).cast("long")).alias("alone")).where("several > 1").select("key", F.col("most.component").alias("major"), "alone"), "mixed")
    open_ones = runtime.stored(labelled.join(mixed, "key").where("component != major OR size = 1").select("key", "id", "component", "size", "alone"), "open-classes")
    wholes = runtime.stored(held.where("size > 1").join(mixed, "key").select("key", F.col("component").alias("other")), "wholes")
    asked = runtime.stored(open_ones.join(wholes, "key").where("component != other").select("id", F.col("other").alias("component")).distinct(), "with-components")
    new = []
    if not asked.isEmpty():
        standing = labels.select("id", "component").join(asked.select("component").distinct(), "component")
        new.append(_linked_in_blocks(docs, classes, asked, standing, width))

    alone = open_ones.where("size = 1").select("key", "id", "alone")
    few = alone.where(F.col("alone") <= FEW).select("key", "id").join(sketches, "id")
    x, y = (few.select("key", F.col("id").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
    pairs = x.join(y, "key").where((F.col("a") > F.col("b")) & _near("sa", "sb")).select("a", "b").distinct()
    pairs = runtime.stored(pairs, "single-pairs")
    if not pairs.isEmpty():
        new.append(_confirmed(docs, classes, pairs, width))
    many = runtime.stored(alone.where(F.col("alone") > FEW).select("id", F.col("key").alias("component")), "many-alone")
    if not many.isEmpty():
        new.append(_linked_in_blocks(docs, classes, many, many, width, apart=True))
    if not new:
        return labels.select("id", "component")
    found = new[0]
    for more in new[1:]:
        found = found.unionByName(more)
    found = runtime.stored(found, "new-links")
    if found.isEmpty():
        return labels.select("id", "component")
    return components(links.unionByName(found))


#: Shingles of the classes that are compared with each other at once.
BLOCK = 1 << 16
#: Tasks that the blocks of one component are dealt over, at most.
SPREAD = 64


def _linked_in_blocks(docs: DataFrame, classes: DataFrame, asked: DataFrame, standing: DataFrame, width: int, apart: bool = False) -> DataFrame:
    """(a, b): links of asked classes to the standing ones of the same component; both sides are (id, component).

    Both are dealt into blocks of about BLOCK shingles and compared block by block; pairs are never listed. The classes of
    a component are linked already, so an asked class needs one link to a block. If they stand ``apart`` (both
    sides are the same classes, without links yet), a block pair gives links that connect all that its links connect.
    """
    spots = classes.select("id", "f", "r", "n")

    def counted(members: DataFrame, name: str) -> DataFrame:
        return runtime.stored(members.join(spots, "id").groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks")), name)

    asked_blocks, standing_blocks = counted(asked, "asked-blocks"), counted(standing, "standing-blocks")

    def work(s: K.Slice, f: int, numbers: np.ndarray, row: np.ndarray, found: np.ndarray) -> dict:
        sets, at = shingle_sets(s, width)
        return {"own": found[:, 0], "component": found[:, 1], "block": found[:, 2], "members": pa.array([sets[at[i] : at[i + 1]].tobytes() for i in row], pa.binary())}

    def blocks(members: DataFrame, totals: DataFrame, name: str) -> DataFrame:
        """(component, block) with a list of ids and sets."""
        dealt = members.join(totals, "component").join(spots, "id").select("f", "r", F.col("id").alias("own"), "component", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
        got = scan_beside(docs, Sidecar.write(dealt, name), work, "own long, component long, block long, members binary")
        # BLOCK bounds the list.
        return got.groupBy("component", "block").agg(F.collect_list(F.struct("own", "members")).alias(name))

    left = blocks(asked, asked_blocks, "asked").join(standing_blocks.withColumnRenamed("blocks", "there"), "component")
    left = left.select("component", F.col("block").alias("mine"), "asked", F.explode(F.expr(f"sequence(0, least(there, {SPREAD}) - 1)")).alias("way"))
    right = blocks(standing, standing_blocks, "standing").withColumn("way", F.pmod("block", F.lit(SPREAD)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(listed):
            own = [x["own"].as_py() for x in listed]
            sets = [np.frombuffer(x["members"].as_buffer(), K.U64) for x in listed]
            return own, sets, np.array([len(x) for x in sets])

        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                a, b = [], []
                own, sets, _ = parts(x.values if hasattr(x, "values") else x)
                others, other_sets, sizes = parts(y.values if hasattr(y, "values") else y)
                flat = np.concatenate(other_sets)
                starts = np.cumsum(sizes) - sizes
                order = np.argsort(flat, kind="stable")
                ranked = flat[order]
                forest: dict[int, int] = {}

                def root(i: int, forest=forest) -> int:
                    while forest.setdefault(i, i) != i:
                        forest[i] = i = forest[forest[i]]
                    return i

                for i, u in zip(own, sets, strict=True):
                    low, high = np.searchsorted(ranked, u, "left"), np.searchsorted(ranked, u, "right")
                    marks = np.zeros(len(flat) + 1, np.int32)
                    np.add.at(marks, low, 1)
                    np.add.at(marks, high, -1)
                    within = np.zeros(len(flat), np.int64)
                    within[order] = np.cumsum(marks[:-1])
                    same = np.add.reduceat(within, starts)
                    hit = np.flatnonzero(100 * same >= PERCENT * (len(u) + sizes - same))
                    for j in (hit if apart else hit[:1]).tolist():
                        if not apart or root(i) != root(others[j]):
                            forest[root(i)] = root(others[j])
                            a.append(i)
                            b.append(others[j])
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    both = left.join(right, ["component", "way"])
    if apart:
        both = both.where("mine <= block")
    return both.select("asked", "standing").mapInArrow(runtime.tidy(run), "a long, b long")


def grouped(docs: DataFrame, width: int) -> DataFrame:
    """Of each row of ``docs`` (which reads files): place, doc_id, size of its set, component (null without a doc_id)."""
    sets = runtime.stored(set_table(docs, width), "sets")
    one, signature = F.struct("doc_id", "f", "r"), F.struct("bands", *(f"s{k}" for k in range(SKETCH)))
    named = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("name1", "name2").agg(F.min(one).alias("one"), F.max("n").alias("n"), F.min_by(signature, one).alias("sig"))
    classes = runtime.stored(named.select("name1", "name2", F.col("one.doc_id").alias("id"), "one.f", "one.r", "n", "sig.*"), "classes")
    linked = linked_classes(docs, classes, width)
    of_class = classes.select("name1", "name2", "id").join(linked, "id", "left").select("name1", "name2", F.coalesce("component", "id").alias("component"))
    named_row = lambda c: F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col(c)).alias(c)
    return sets.select("f", "r", "doc_id", "n", named_row("name1"), named_row("name2")).join(of_class, ["name1", "name2"], "left").select("f", "r", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))


def _long_ids(docs: DataFrame) -> DataFrame:
    return at_rest(docs if dict(docs.dtypes)["doc_id"] == "bigint" else docs.withColumn("doc_id", F.col("doc_id").cast("long")))


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that links reach, ``kept`` tells whether it is the row's own. A null or
    empty text, or one without words, has no shingles and no links. Rows with equal sets are in one component,
    also rows that repeat; rows that share a doc_id but not their text each follow their text. A row without a
    doc_id is linked with nothing and has null as component and ``kept``. An empty table gives an empty one. A very
    long text has its whole set.
    """
    runtime.ship(docs.sparkSession)
    return grouped(_long_ids(docs), width).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest doc_id, of equal ones the first read.

    Rows without words or doc_id stay, a null text among them; an empty table gives an empty one.
    """
    runtime.ship(docs.sparkSession)
    rested = _long_ids(docs)
    rows = runtime.stored(grouped(rested, width).where("n > 0 AND doc_id IS NOT NULL").select("f", "r", "doc_id", "component"), "groups")
    # A component is its smallest doc_id, so that all rows but those of that doc_id go without meeting the others.
    named = rows.where("doc_id = component")
    best = named.groupBy("component").agg(F.min(F.struct("f", "r")).alias("best"), F.count("*").alias("n")).where("n > 1").select("component", "best")
    best = runtime.stored(best, "best-rows")
    repeated = named.join(best, "component").where("f != best.f OR r != best.r")
    side = Sidecar.write(rows.where("doc_id != component").select("f", "r").unionByName(repeated.select("f", "r")), "duplicates")
    columns = rested.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = side.reader()
        for batch in batches:
            for f, numbers, part in files_of(batch):
                stays = np.ones(len(numbers), bool)
                stays[find(f, numbers)[0]] = False
                yield pa.RecordBatch.from_arrays(part.columns[2:], names=columns).filter(pa.array(stays))

    return rested.select(*place(rested), *(rested[c] for c in columns)).mapInArrow(runtime.tidy(run), rested.schema)
