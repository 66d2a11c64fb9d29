"""Encoding whole texts piece by piece: each distinct piece of a batch is encoded once, by any encoder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from . import textkit as K


class Ragged:
    """A growing list of integer rows, kept as flat arrays."""

    def __init__(self):
        self.starts, self.lengths, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.n = self.used = 0

    def extend(self, rows: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        total = int(lengths.sum())
        while self.n + len(rows) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.fromiter((y for x in rows for y in x), np.uint32, total)
        self.starts[self.n : self.n + len(rows)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.n : self.n + len(rows)] = lengths
        self.n += len(rows)
        self.used += total


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``flat[start : start + length]``."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class PieceEncoder:
    """Encodes slices of text by an encoder of single pieces.

    ``encode_pieces`` gets a list of distinct byte strings and returns their ids. Known pieces are kept
    for later batches; when they are more than ``keep``, or have more than ``keep_bytes``, they are forgotten
    together, which costs time only.
    """

    def __init__(self, encode_pieces: Callable[[list[bytes]], list[list[int]]], keep: int = 300_000, keep_bytes: int = 16 << 20):
        self._encode, self._keep, self._keep_bytes = encode_pieces, keep, keep_bytes
        self.forget()

    def forget(self) -> None:
        self._known: dict[bytes, int] = {}
        self._rows = Ragged()
        self._bytes = 0

    def encode(self, s: K.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids of each row)."""
        n = s.hi - s.lo
        bounds = K.pieces(s)
        if len(bounds) < 2:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        column = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(s.buf))])
        coded = column.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self._known) + len(words) > self._keep or self._bytes > self._keep_bytes:
            self.forget()
        known = self._known
        new = [w for w in words if w not in known]
        if new:
            self._bytes += sum(map(len, new))
            self._rows.extend(self._encode(new))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        which = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        lengths = self._rows.lengths[which]
        ids = gather(self._rows.flat, self._rows.starts[which], lengths)
        before = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(before[np.searchsorted(bounds, s.offsets)])


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte, as a table for str.translate."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}
