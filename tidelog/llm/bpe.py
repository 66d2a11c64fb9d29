"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

The encoding of any prefix of a piece is the encoding of a shorter prefix and one more token, and a sequence
of tokens is an encoding just if each neighbouring pair is (the pair's bytes encode to the pair). So reading
left to right it is enough to know, for each prefix, its last token. A later token can begin only where the
bytes since then are the start of some token of the vocabulary: the transducer looks back no further than the
longest token. Once all places where a token may still begin share a prefix of the encoding, that prefix is emitted.

A state is what remains to be known: the pending bytes and the last tokens at the places that still count.
A transition is made when it is needed for the second time and then kept, so frequent texts run on one table lookup
a byte; the first time, the few bytes that are left of a piece are followed place by place, without states. The table is bounded: with ``limit`` transitions it is made anew, also in the middle of a piece, and it is
given back at the end of each task, so that an idle worker holds the vocabulary alone.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import runtime
from . import textkit as K
from .tokens import PieceEncoder, gather


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a ``.tiktoken`` file: token bytes and their ranks, which are the ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: Bytes left of a piece that may be followed without states.
FOLLOWED = 64


class Transducer:
    def __init__(self, ranks: dict[bytes, int], limit: int = 400_000):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        self.ranks, self._limit = ranks, limit
        self.token = {v: k for k, v in ranks.items()}
        self._begins = {t[:k] for t in ranks for k in range(1, len(t))}
        self._halves: dict[int, tuple[int, ...] | None] = {}
        self.forget()

    def forget(self) -> None:
        """Give the states and transitions back; they are made again when needed."""
        self._states: list[tuple] = []
        self._number: dict[tuple, int] = {}
        self._next: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._final: dict[int, tuple[int, ...]] = {}
        self._fits: dict[int, bool] = {}
        self._start = self._state((b"", (-1,), (0,), (1,)))

    def _state(self, state: tuple) -> int:
        """The number of a state, a multiple of 256: (pending bytes, last tokens, live places, their paths)."""
        number = self._number.get(state[:2])
        if number is None:
            number = self._number[state[:2]] = len(self._states) << 8
            self._states.append(state)
        return number

    def _merged(self, data: bytes, least: int) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merge(self, data: bytes) -> list[int]:
        """BPE by its definition: merge the neighbours with the lowest rank, the first of equals, until none is left."""
        return [self.ranks[p] for p in self._merged(data, 1)]

    def _split(self, t: int) -> tuple[int, ...] | None:
        """The two tokens that merge into ``t``; () for a byte, None for a token that merging its bytes does not reach."""
        if t not in self._halves:
            data = self.token[t]
            parts = [self.ranks[p] for p in self._merged(data, 2)] if len(data) > 1 else []
            if max(parts, default=-1) > t:
                raise ValueError(f"the vocabulary ranks token {t} before its parts")
            self._halves[t] = tuple(parts) if len(parts) < 3 else None
        return self._halves[t]

    def _pair(self, a: int, b: int) -> bool:
        key = a << 32 | b
        fits = self._fits.get(key)
        if fits is None:
            if len(self._fits) >= self._limit >> 1:
                self._fits.clear()
            fits = self._fits[key] = self._neighbours(a, b)
        return fits

    def _neighbours(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` encode to just these two.

        Merges are undone from the last one back, those that end at the boundary; if a merge across it would have come
        first at any time, it is not so. Of equal ranks the left one is merged first.
        """
        bound, ranks, token, halves = 1 << 62, self.ranks, self.token, self._halves
        while True:
            across = ranks.get(token[a] + token[b])
            if across is not None and across < bound:
                return False
            left, right = halves.get(a) or self._split(a), halves.get(b) or self._split(b)
            if left and (a > b or not right):
                bound, a = a, left[1]
            elif right:
                bound, b = b + 1, right[0]
            else:
                return True

    def _follow(self, state: int, data: bytes) -> list[int]:
        """The ids from ``state`` to the end of a piece that goes on with ``data``; no state is made."""
        pending, last, live, _ = self._states[state >> 8]
        n, data, last = len(pending), pending + data, [*last]
        ranks, begins, halves = self.ranks, self._begins, self._halves
        while n < len(data):
            n += 1
            for j in live:
                t = ranks.get(data[j:n])
                if t is not None and (halves[t] if t in halves else self._split(t)) is not None and (last[j] == -1 or self._pair(last[j], t)):
                    break
            else:
                raise AssertionError("the vocabulary does not encode its own prefixes")
            last.append(t)
            live = [i for i in live if data[i:n] in begins]
            live.append(n)
        out = []
        while n > 0:
            out.append(last[n])
            n -= len(self.token[last[n]])
        out.reverse()
        return out

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """``last[j]``: the last token of the encoding that ends after j pending bytes; -1: none yet, None: never asked for.

        A place is live if a token may still begin there; its path has the ends of the tokens up to it, as bits.
        """
        pending, last, live, paths = self._states[state >> 8]
        pending += bytes((byte,))
        n, ranks, begins = len(pending), self.ranks, self._begins
        for j, path in zip(live, paths, strict=True):
            t = ranks.get(pending[j:])
            if t is not None and self._split(t) is not None and (last[j] == -1 or self._pair(last[j], t)):
                break
        else:
            raise AssertionError("the vocabulary does not encode its own prefixes")
        shared = needed = path = path | 1 << n
        still, kept_paths = [], []
        for i, p in zip(live, paths, strict=True):
            if pending[i:] in begins:
                still.append(i)
                kept_paths.append(p)
                shared &= p
                needed |= p
        still.append(n)
        kept_paths.append(path)
        common = shared.bit_length() - 1
        last = (*last, t)
        emitted = []
        i = common
        while i > 0:
            emitted.append(last[i])
            i -= len(self.token[last[i]])
        # The token before the base matters only to a token that may begin there.
        kept = tuple([last[i] if needed >> i & 1 and (i > common or i in still) else None for i in range(common, n + 1)])
        if common:
            still, kept_paths = [i - common for i in still], [p >> common for p in kept_paths]
        return self._state((pending[common:], kept, tuple(still), tuple(kept_paths))), tuple(reversed(emitted))

    def _rest(self, state: int) -> tuple[int, ...]:
        pending, last = self._states[state >> 8][:2]
        out, j = [], len(pending)
        while j > 0:
            out.append(last[j])
            j -= len(self.token[last[j]])
        return tuple(reversed(out))

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out, known = self._start, [], self._next
        for at, byte in enumerate(piece):
            step = known.get(state | byte)
            if not step:
                if len(known) >= self._limit:
                    here = self._states[state >> 8]
                    self.forget()
                    state, known = self._state(here), self._next
                if step is None and len(piece) - at <= FOLLOWED:
                    known[state | byte] = ()
                    return out + self._follow(state, piece[at:])
                step = known[state | byte] = self._step(state, byte)
            state, emitted = step
            if emitted:
                out += emitted
        rest = self._final.get(state)
        if rest is None:
            rest = self._final[state] = self._rest(state)
        out += rest
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        return [self.encode(p) for p in pieces]


class StreamDecoder:
    """Text from ids as they come: characters cut by a token's end wait for their other bytes."""

    def __init__(self, token: dict[int, bytes], errors: str = "replace"):
        self._token, self._machine = token, codecs.getincrementaldecoder("utf-8")(errors)

    def feed(self, ids: Iterable[int]) -> str:
        return self._machine.decode(b"".join(self._token[i] for i in ids))

    def end(self) -> str:
        return self._machine.decode(b"", final=True)


class Rendered:
    """Byte strings of all ids, to write many ids at once."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def write(self, ids: np.ndarray, counts: np.ndarray) -> tuple[memoryview, list[int]]:
        """The strings of ``ids`` one after the other, and where those of each row begin (with the end)."""
        lengths = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return memoryview(gather(self.flat, self.starts[ids], lengths)), ends[np.concatenate([[0], np.cumsum(counts)])].tolist()


class Codec:
    """Encoder and decoder of one vocabulary in one worker."""

    def __init__(self, path: str):
        self.transducer = Transducer(read_ranks(path))
        self.encoder = PieceEncoder(self.transducer.encode_pieces)
        size = max(self.transducer.token) + 1
        self.token_bytes = Rendered([self.transducer.token.get(i, b"") for i in range(size)])
        self.decimals = Rendered([b"%d," % i for i in range(size)])

    def forget(self) -> None:
        """Give back what was kept for later texts."""
        self.encoder.forget()
        self.transducer.forget()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


#: Ids of a long row are written and decoded in runs of so many.
RUN = 1 << 20


def _digests(c: Codec, ids: np.ndarray, counts: np.ndarray) -> tuple[list[str], list[str]]:
    shown, decoded = [], []
    text, at = c.decimals.write(ids, counts)
    raw, raw_at = c.token_bytes.write(ids, counts)
    for a, b, x, y in zip(at, at[1:], raw_at, raw_at[1:], strict=False):
        shown.append(hashlib.sha256(text[a : max(a, b - 1)]).hexdigest())
        machine, digest = codecs.getincrementaldecoder("utf-8")("surrogateescape"), hashlib.sha256()
        for k in range(x, y, RUN):
            digest.update(machine.decode(raw[k : min(y, k + RUN)]).encode("utf-8", "surrogateescape"))
        digest.update(machine.decode(b"", final=True).encode("utf-8", "surrogateescape"))
        decoded.append(digest.hexdigest())
    return shown, decoded


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _encoded(docs: DataFrame, path: str, with_ids: bool) -> DataFrame:
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        try:
            for batch in batches:
                for s in K.slices(batch.column(1)):
                    ids, counts = c.encoder.encode(s)
                    shown, decoded = _digests(c, ids, counts)
                    columns = {"doc_id": batch.column(0).slice(s.lo, s.hi - s.lo).cast(pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(shown), "decoded_sha256": pa.array(decoded)}
                    if with_ids:
                        columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(columns)
        finally:
            c.forget()

    return docs.select("doc_id", "text").mapInArrow(runtime.tidy(run), DIGEST + ", ids array<int>" * with_ids)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): how many ids its text has, and digests of the ids and of what they decode to.

    A null text is empty and has no ids; an empty table gives an empty one; a row without a doc_id is answered under a
    null one. Rows that repeat are each answered. A very long text is one slice by itself: memory grows with the longest
    text, not with the number of texts. No shuffle.
    """
    return _encoded(docs, path, False)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Like :func:`encode_digests`, with the ids themselves in ``ids``."""
    return _encoded(docs, path, True)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` of each row of ``encoded`` (doc_id, ids); bytes that are no UTF-8 become U+FFFD, null ids an empty text."""
    runtime.ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = codec(path).transducer.token
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                d = StreamDecoder(token)
                values = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int64)
                texts.append("".join([*(d.feed(values[k : k + RUN].tolist()) for k in range(0, len(values), RUN)), d.end()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(runtime.tidy(run), "doc_id long, text string")
