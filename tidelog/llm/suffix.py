"""Removal of repeated passages by prefix-free parsing of the corpus, to the order of LENGTH bytes.

A rolling hash of GRAM bytes picks triggers: in every window of LENGTH bytes the place of its least hash. The
consecutive windows with the same trigger form a phrase, the text from the first of them to the end of the last
one. Where a trigger stands depends on the window's bytes alone, so equal windows have equal triggers at equal offsets, and
phrases have at most 2 * LENGTH - GRAM bytes whatever the text. Distinct phrases are the dictionary; the corpus is
the sequence of their numbers.

A suffix array of the corpus would put suffixes with the same first LENGTH bytes next to each other; a window is
repeated just if it has such a neighbour. The parse gives these classes without sorting the corpus:
    1. A phrase that stands more than once has all its windows repeated.
    2. A window of a phrase that stands once can only have its neighbour in another phrase with the same trigger.
       Phrases that share their trigger with no other have none. The rest are cut into blocks of BLOCK windows, by
       their distance from the trigger, and blocks are treated like phrases, the bytes that all windows of a
       block share being their trigger.
    3. Single windows of the blocks that remain are compared by their hashes.
All three are counts by 64-bit names (hashes), summed in each task before they are shuffled; the dictionary is never
collected. The text itself is not shuffled: what is found of a row goes into small files by place in the input
(:class:`Sidecar`), which later scans of the same files read beside the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from . import textkit as K
from .places import Sidecar, at_rest, files_of, place, scan, scan_beside

LENGTH = 400
GRAM = 160
BLOCK = 16

def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Phrases:
    """The phrases of a slice: row, first and last window start, trigger's place, names of trigger and phrase.

    ``first``, ``last`` and ``trigger`` are byte positions in the slice.
    """

    def __init__(self, s: K.Slice, length: int = LENGTH, gram: int = GRAM):
        n, sizes = len(s.buf), np.diff(s.offsets)
        long = sizes >= length
        if not long.any():
            self.row = self.first = self.last = self.trigger = np.zeros(0, np.int64)
            self.key = self.name = np.zeros(0, K.U64)
            return
        prefix = K.prefix_hash(s.buf)
        _, down = K.powers(n + 1)
        grams = K.mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
        bits = K.U64((1 << n.bit_length()) - 1)
        # The lowest bits give way to the place, so that the last of equals wins.
        placed = (grams & ~bits) | (bits - np.arange(len(grams), dtype=K.U64))
        trigger = (bits - (sliding_min(placed, length - gram + 1) & bits)).astype(np.int64)
        inside = np.zeros(n + 1, np.int32)
        np.add.at(inside, s.offsets[:-1][long], 1)
        np.add.at(inside, s.offsets[1:][long] - length + 1, -1)
        valid = np.cumsum(inside[: len(trigger)]) > 0
        cut = np.ones(len(trigger) + 1, bool)
        cut[1:-1] = (trigger[1:] != trigger[:-1]) | (valid[1:] != valid[:-1])
        starts = s.offsets[s.offsets < len(trigger)]
        cut[starts] = True
        cuts = np.flatnonzero(cut)
        keep = valid[cuts[:-1]]
        self.first, self.last = cuts[:-1][keep], cuts[1:][keep] - 1
        self.trigger = trigger[self.first]
        self.row = s.rows_of(self.first)
        self.key = grams[self.trigger]
        self.name = K.mix(K.span_hash(prefix, self.first, self.last + length) + (self.trigger - self.first).astype(K.U64))


def blocks_of(s: K.Slice, prefix: np.ndarray, first: np.ndarray, last: np.ndarray, trigger: np.ndarray, length: int, block: int) -> tuple[np.ndarray, ...]:
    """(phrase, first, last, key, name) of the blocks of phrases; positions are in the slice."""
    near, far = (trigger - last) // block, (trigger - first) // block
    count = far - near + 1
    phrase = np.repeat(np.arange(len(first)), count)
    b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + near[phrase]
    low, high = trigger[phrase] - block * b - block + 1, trigger[phrase] - block * b
    a, z = np.maximum(low, first[phrase]), np.minimum(high, last[phrase])
    order = b.astype(K.U64)
    key = K.mix(K.span_hash(prefix, high, low + length) + order)
    name = K.mix(K.span_hash(prefix, a, z + length) + order * K.U64(1 << 20) + (a - low).astype(K.U64))
    return phrase, a, z, key, name


_SIGNED = lambda x: x.view(np.int64)
_NAMED = "key long, name long, f long, r long, first long, last long, trigger long, known long"


def phrase_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def work(s: K.Slice, f: int, numbers: np.ndarray) -> dict | None:
        p = Phrases(s, length, gram)
        if not len(p.row):
            return None
        base = s.offsets[p.row]
        return {"key": _SIGNED(p.key), "name": _SIGNED(p.name), "f": np.full(len(base), f), "r": numbers[p.row], "first": p.first - base, "last": p.last - base, "trigger": p.trigger - base, "known": np.zeros(len(base), np.int64)}

    return scan(docs, work, _NAMED)


def block_table(docs: DataFrame, side: Sidecar, length: int, block: int) -> DataFrame:
    """Blocks of the phrases in ``side`` (first, last, trigger, known)."""

    def work(s: K.Slice, f: int, numbers: np.ndarray, row: np.ndarray, found: np.ndarray) -> dict:
        base = s.offsets[row]
        first, last, trigger = (found[:, k] + base for k in range(3))
        phrase, a, z, key, name = blocks_of(s, K.prefix_hash(s.buf), first, last, trigger, length, block)
        base = base[phrase]
        return {"key": _SIGNED(key), "name": _SIGNED(name), "f": np.full(len(a), f), "r": numbers[row[phrase]], "first": a - base, "last": z - base, "trigger": a - base, "known": found[phrase, 3]}

    return scan_beside(docs, side, work, _NAMED)


def window_table(docs: DataFrame, side: Sidecar, length: int) -> DataFrame:
    """Single windows of the blocks in ``side`` (first, last, trigger, known)."""

    def work(s: K.Slice, f: int, numbers: np.ndarray, row: np.ndarray, found: np.ndarray) -> dict:
        count = found[:, 1] - found[:, 0] + 1
        block = np.repeat(np.arange(len(row)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + found[block, 0]
        start = at + s.offsets[row[block]]
        name = _SIGNED(K.span_hash(K.prefix_hash(s.buf), start, start + length))
        return {"key": name, "name": name, "f": np.full(len(at), f), "r": numbers[row[block]], "first": at, "last": at, "trigger": at, "known": found[block, 3]}

    return scan_beside(docs, side, work, _NAMED)


def _sorted_out(named: DataFrame, purpose: str) -> tuple[DataFrame, DataFrame]:
    """(repeated, open) of a table of phrases, blocks or windows.

    ``repeated`` are the places whose name stands more than once; ``open`` are those, one of each name, whose key
    has several names: their windows must be told apart. A place known to be repeated stays in ``open`` for others.
    """
    names = named.groupBy("key", "name").agg(F.count("*").alias("n"), F.max("known").alias("known"), F.min(F.struct("f", "r", "first", "last", "trigger")).alias("one"))
    kinds = names.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("places")).where("places > 1").select("key", "kinds")
    names = runtime.stored(names.join(kinds, "key"), purpose)
    repeated = named.where("known = 0").join(names.where("n > 1").select("key", "name"), ["key", "name"]).select("f", "r", "first", "last")
    rest = names.where("kinds > 1").select("one.*", F.when(F.col("n") > 1, 1).otherwise(F.col("known")).alias("known"))
    return repeated, rest


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(f, r, first, last): runs of window starts, in bytes of the row's text, whose windows stand elsewhere too. ``docs`` reads files."""
    phrases = runtime.stored(phrase_table(docs, length, gram), "all-phrases")
    found, rest = _sorted_out(phrases, "phrases")
    blocks = runtime.stored(block_table(docs, Sidecar.write(rest, "open-phrases"), length, block), "blocks")
    found_blocks, rest = _sorted_out(blocks, "block-names")
    windows = runtime.stored(window_table(docs, Sidecar.write(rest, "open-blocks"), length), "windows")
    found_windows, _ = _sorted_out(windows, "window-names")
    return found.unionByName(found_blocks).unionByName(found_windows)


def _covered(s: K.Slice, row: np.ndarray, found: np.ndarray, length: int) -> np.ndarray:
    """Whether each byte of the slice is removed."""
    change = np.zeros(len(s.buf) + 1, np.int32)
    base = s.offsets[row]
    np.add.at(change, base + found[:, 0], 1)
    np.add.at(change, base + found[:, 1] + length, -1)
    return np.cumsum(change[:-1]) > 0


def _with_repeats(docs: DataFrame, length: int, columns: list[str], work: Callable, schema) -> DataFrame:
    """Apply ``work`` to slices of ``docs``: the slice, its rows of ``columns``, what is removed, and of which rows."""
    side = Sidecar.write(repeated_starts(docs, length), "repeats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = side.reader()
        for batch in batches:
            for f, numbers, part in files_of(batch):
                own = pa.RecordBatch.from_arrays(part.columns[3:], names=columns)
                for s in K.slices(part.column(2)):
                    row, found = find(f, numbers[s.lo : s.hi])
                    yield work(s, own.slice(s.lo, s.hi - s.lo), _covered(s, row, found, length), row)

    return docs.select(*place(docs), docs["text"].alias("__text"), *(docs[c] for c in columns)).mapInArrow(runtime.tidy(run), schema)


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """What is removed of each row of ``docs`` (doc_id, text), and the digest of what stays.

    Texts are UTF-8 bytes, a null one is empty; no match crosses rows. Every byte that a string of ``length`` bytes
    covers goes if that string starts anywhere else as well, in this row or in another. Repeated rows of ``length``
    bytes or more go whole; shorter ones and empty tables stay as they are. A very long text is one slice by itself.
    """
    runtime.ship(docs.sparkSession)

    def work(s: K.Slice, part: pa.RecordBatch, gone: np.ndarray, _) -> pa.RecordBatch:
        edge = np.zeros(len(gone) + 1, bool)
        edge[:-1] = gone
        edge[1:-1] &= ~gone[:-1]
        edge[s.offsets[:-1]] |= np.append(gone, False)[s.offsets[:-1]]
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[s.offsets])
        digests = []
        for a, b in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True):
            digests.append(hashlib.sha256(s.buf[a:b][~gone[a:b]].tobytes()).hexdigest())
        return pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n_bytes": np.diff(s.offsets), "n_removed": total(gone.astype(np.int64)), "n_spans": total(edge[:-1].astype(np.int64)), "kept_sha256": digests})

    return _with_repeats(at_rest(docs), length, ["doc_id"], work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with its repeated passages taken out of ``text``; other columns stay (``n_chars``, if there, is counted anew).

    Characters of which only some bytes go, go whole. Rows stay, also those left empty; a null text stays null.
    """
    runtime.ship(docs.sparkSession)
    rested = at_rest(docs)
    columns = rested.columns

    def work(s: K.Slice, part: pa.RecordBatch, gone: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
        out = part
        if not len(row):
            return out
        text = part.column("text").to_pylist()
        counts = part.column("n_chars").to_pylist() if "n_chars" in columns else None
        for i in K.distinct(row.copy()).tolist():
            a, b = s.offsets[i], s.offsets[i + 1]
            first = (s.buf[a:b] & 0xC0) != 0x80
            first[0] = True
            # What is left of characters on both sides of a passage must not make another one.
            cut = np.logical_or.reduceat(gone[a:b], np.flatnonzero(first))
            text[i] = s.buf[a:b][~cut[np.cumsum(first) - 1]].tobytes().decode("utf-8", "ignore")
            if counts is not None:
                counts[i] = len(text[i])
        for name, values in (("text", text), ("n_chars", counts)):
            if values is not None:
                k = columns.index(name)
                out = out.set_column(k, name, pa.array(values, out.schema.field(k).type))
        return out

    return _with_repeats(rested, length, columns, work, rested.schema)
