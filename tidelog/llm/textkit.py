"""Vectorised work on columns of UTF-8 text: slices of Arrow batches as byte arrays, word spans, hashes of spans.

Everything here sees a slice of rows as one byte array plus row offsets, so that the cost of a row is
some numpy passes over its bytes and never a Python loop over its words.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once, unless a row is longer; all arrays of a worker are small multiples of this.
SLICE_BYTES = 512 << 10
U64 = np.uint64


class Slice(NamedTuple):
    lo: int
    hi: int
    buf: np.ndarray
    offsets: np.ndarray

    def rows_of(self, positions: np.ndarray) -> np.ndarray:
        """The row, counted from 0 in this slice, that holds each byte position."""
        return np.searchsorted(self.offsets, positions, side="right") - 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary()
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else wide)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Runs of whole rows of about ``limit`` bytes; a longer row is a slice by itself."""
    buf, offsets = text_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Slice(lo, hi, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def byte_table(members: bytes | range | list[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


def _complement(separators: list[int]) -> np.ndarray:
    return ~byte_table(separators)


#: Words between white space: the bytes outside 20 and 09-0D.
SPACED = _complement([0x20, *range(0x09, 0x0E)])
#: Words of ASCII letters and digits and everything beyond ASCII, upper case included (it is lowered).
ALNUM = _complement([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def spans(s: Slice, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``word`` bytes; no run crosses a row."""
    n = len(s.buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = word[s.buf]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = inside[1:] != inside[:-1]
    edge[s.offsets] = True
    cuts = np.flatnonzero(edge)
    keep = inside[cuts[:-1]]
    return cuts[:-1][keep], cuts[1:][keep]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INVERSE):
        p = np.empty(n, U64)
        p[0] = 1
        have, step = 1, base
        while have < n:
            take = min(have, n - have)
            p[have : have + take] = p[:take] * U64(step)
            have += take
            step = step * step % (1 << 64)
        out.append(p)
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base of the rolling hash, and of its inverse, modulo 2**64."""
    size = max(SLICE_BYTES + 1, 1 << max(0, n - 1).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def _values(lowered: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))
    return v[LOWER] if lowered else v


RAW_VALUES, LOWER_VALUES = _values(False), _values(True)


def prefix_hash(buf: np.ndarray, values: np.ndarray = RAW_VALUES) -> np.ndarray:
    """Prefix sums of the polynomial hash; with :func:`span_hash` it gives the hash of any span."""
    up, _ = powers(max(1, len(buf)))
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(values[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans: equal bytes give equal hashes wherever they stand; the length counts too."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0x632BE59BD9B4E019))


def hash_text(text: str | bytes, values: np.ndarray = RAW_VALUES) -> int:
    """The hash that :func:`span_hash` gives a span with these bytes."""
    data = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)
    p = prefix_hash(data, values)
    return int(span_hash(p, np.array([0]), np.array([len(data)]))[0])


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending; by a sort in place, which is many times as fast here as a hash table."""
    x.sort()
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


# --- the pre-tokenizer of byte-level BPE -------------------------------------------------------

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
_TAILS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point, taken from the same Unicode properties that the pattern names."""
    import regex

    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, name in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        for run in regex.findall(f"{name}+", every):
            out[np.frombuffer(run.encode("utf-32-le"), np.uint32)] = kind
    return out


def _code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions of the characters and their code points."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    cp = buf[at].astype(np.int32)
    if len(at) == len(buf):
        return at, cp
    wide = np.flatnonzero(cp >= 0x80)
    lead, where = cp[wide], at[wide]
    b1, b2, b3 = (buf[np.minimum(where + k, len(buf) - 1)].astype(np.int32) & 0x3F for k in (1, 2, 3))
    two, three, four = (lead & 0x1F) << 6 | b1, (lead & 0x0F) << 12 | b1 << 6 | b2, (lead & 0x07) << 18 | b1 << 12 | b2 << 6 | b3
    cp[wide] = np.minimum(np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four)), 0x10FFFF)
    return at, cp


def pieces(s: Slice) -> np.ndarray:
    """Byte boundaries of the matches of the byte-level BPE pattern (they tile the text), with 0 and the end.

    The pattern: contractions, an optional blank and a run of letters, numbers or other characters, white
    space up to the last of a run that text follows, and other white space.
    """
    n = len(s.buf)
    if not n:
        return np.zeros(1, np.int64)
    at, cp = _code_points(s.buf)
    m = len(at)
    kind = _classes()[cp]
    first = np.zeros(m + 1, bool)  # characters that begin a row
    first[np.searchsorted(at, s.offsets)] = True
    cut = np.zeros(m + 1, bool)
    cut[1:m] = kind[1:] != kind[:-1]
    cut |= first
    runs = np.flatnonzero(cut)  # with m at the end
    begins, ends = runs[:-1], runs[1:]
    # White space before text: its last character stands apart; a blank joins the text.
    space = kind[begins] == _SPACE
    followed = space & ~first[ends]
    last = ends[followed] - 1
    blank = cp[last] == 0x20
    cut[last] = True
    cut[ends[followed][blank]] = False
    # Contractions: an apostrophe that is a run by itself, not joined to a blank, then letters.
    single = begins[(cp[begins] == 0x27) & (ends - begins == 1)]
    single = single[cut[single] & ~first[single + 1]]
    if len(single):
        ext = np.concatenate([cp, np.full(3, -1)])
        starts_row = np.concatenate([first, np.zeros(3, bool)])
        for tail in _TAILS:
            k = len(tail)
            hit = ext[single + 1] == tail[0]
            if k == 2:
                hit &= (ext[single + 2] == tail[1]) & ~starts_row[single + 2]
            p = single[hit]
            cut[p + 1] = False
            cut[p + 1 + k] = True
    cut |= first
    places = np.flatnonzero(cut)
    return np.concatenate([at, [n]])[places]
