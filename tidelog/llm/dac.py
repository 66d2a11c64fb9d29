"""Token ids as directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level 0 holds the lowest chunk of every id; a
continuation bitmap says which ids go on, and level k + 1 holds the next chunk of just those. A rank
directory (ones before each block of 512 bits) turns a position at one level into the position at the
next, so any single id is read with one chunk, one bitmap block and one directory entry for each level:
nothing before it is decoded.

File layout, integers little-endian:
    magic ``DACIDS01``, u32 levels, u32 zero, u64 ids, u64 documents
    document table: i64 doc_id of each document, u64 position of its first id, and at the end the ids' number
    for each level: u64 entries, u64 ones in its bitmap, the chunks (one byte each) and, but for the last level,
    the bitmap padded to whole blocks of 64 bytes and the directory (u64 for each block)

Files hold ascending ranges of doc_id; a small table of files says where each range starts in the whole
sequence of ids. Writing shuffles each text once, by range of doc_id. Rows that repeat a doc_id stay next to
each other in the order of their texts. A null text is an empty one: it has only the end id. Rows without a doc_id
have no place in that order and are left out; an empty table gives no files and no rows. A very long text is encoded
in one piece, and a task holds the ids of its whole file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runtime
from . import textkit as K
from .tokens import PieceEncoder, byte_alphabet

MAGIC = b"DACIDS01"
BLOCK_BITS = 512
_HEAD = struct.Struct("<8sIIQQ")
_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def pack(ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A file with these ids; ``counts`` are the ids of each document."""
    ids = np.ascontiguousarray(ids, np.uint64)
    levels, rest = [], ids
    while True:
        more = rest > 0xFF
        levels.append(((rest & np.uint64(0xFF)).astype(np.uint8), more))
        rest = rest[more] >> np.uint64(8)
        if not len(rest):
            break
    out = [_HEAD.pack(MAGIC, len(levels), 0, len(ids), len(doc_ids)), np.asarray(doc_ids, "<i8").tobytes()]
    out.append(np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes())
    for k, (chunks, more) in enumerate(levels):
        out += [struct.pack("<QQ", len(chunks), int(more.sum())), chunks.tobytes()]
        if k + 1 < len(levels):
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK_BITS // 8), np.uint8)])
            ones = _POPCOUNT[bits].reshape(-1, BLOCK_BITS // 8).sum(axis=1, dtype=np.uint64)
            out += [bits.tobytes(), (np.cumsum(ones) - ones).astype("<u8").tobytes()]
    return b"".join(out)


class Reader:
    """Reads one file by position; :meth:`access` touches a few bytes for each id asked for."""

    def __init__(self, source):
        self._source = source
        magic, levels, _, self.n_ids, self.n_docs = _HEAD.unpack(source.read_at(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a file of directly addressable ids")
        at = _HEAD.size
        self._docs_at = at
        at += 8 * self.n_docs + 8 * (self.n_docs + 1)
        self._levels = []
        for k in range(levels):
            n, _ones = struct.unpack("<QQ", source.read_at(at, 16))
            chunks = at + 16
            bits = chunks + n
            blocks = -(-n // BLOCK_BITS) if k + 1 < levels else 0
            directory = bits + blocks * (BLOCK_BITS // 8)
            at = directory + 8 * blocks
            self._levels.append((n, chunks, bits, directory, blocks))

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids, and the positions of their first ids with the number of ids at the end."""
        raw = self._source.read_at(self._docs_at, 8 * self.n_docs + 8 * (self.n_docs + 1))
        return np.frombuffer(raw, "<i8", self.n_docs), np.frombuffer(raw, "<u8", self.n_docs + 1, 8 * self.n_docs).astype(np.int64)

    def access(self, position: int) -> int:
        """The id at a position, 0 for the first."""
        if not 0 <= position < self.n_ids:
            raise IndexError(position)
        value, read = 0, self._source.read_at
        for k, (_, chunks, bits, directory, blocks) in enumerate(self._levels):
            value |= read(chunks + position, 1)[0] << (8 * k)
            if not blocks:
                break
            block, bit = divmod(position, BLOCK_BITS)
            word = int.from_bytes(read(bits + block * (BLOCK_BITS // 8), BLOCK_BITS // 8), "little")
            if not word >> bit & 1:
                break
            position = int.from_bytes(read(directory + 8 * block, 8), "little") + (word & ((1 << bit) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        """Every id of the file, level by level from the deepest."""
        deeper = np.zeros(0, np.uint32)
        for n, chunks, bits, _, blocks in reversed(self._levels):
            values = np.frombuffer(self._source.read_at(chunks, n), np.uint8).astype(np.uint32)
            if blocks:
                more = np.unpackbits(np.frombuffer(self._source.read_at(bits, blocks * (BLOCK_BITS // 8)), np.uint8), count=n, bitorder="little").astype(bool)
                values[more] |= deeper << np.uint32(8)
            deeper = values
        return deeper


class AddedTokenEncoder:
    """The ids that the library gives by default: rows with the string of an added token go to the library whole."""

    def __init__(self, plain: PieceEncoder, tokenizer):
        self._plain, self._tokenizer = plain, tokenizer
        self._strings = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values() if t.content]

    def encode(self, s: K.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids of each row)."""
        got, n = self._plain.encode(s)
        raw = s.buf.tobytes()
        if not any(x in raw for x in self._strings):
            return got, n
        ends, at, parts = np.cumsum(n), 0, []
        for row, (a, b) in enumerate(zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)):
            text = raw[a:b]
            if any(x in text for x in self._strings):
                own = self._tokenizer.encode(text.decode(errors="replace"), add_special_tokens=False).ids
                parts += [got[at : ends[row] - n[row]], np.array(own, got.dtype)]
                at, n[row] = ends[row], len(own)
        return np.concatenate([*parts, got[at:]]), n


_encoders: dict[tuple[str, bool], PieceEncoder | AddedTokenEncoder] = {}


def encoder(tokenizer_file: str, added_tokens: bool = False) -> PieceEncoder | AddedTokenEncoder:
    """Byte-level BPE of a ``tokenizers`` file.

    With ``added_tokens`` the strings of the file's added tokens get their own ids, as by default in the library;
    without it they are ordinary text, as with its ``encode_special_tokens``.
    """
    if (tokenizer_file, added_tokens) not in _encoders:
        import tokenizers

        tokenizer = tokenizers.Tokenizer.from_file(tokenizer_file)
        settings = str(tokenizer.pre_tokenizer)
        if tokenizer.normalizer is not None or "ByteLevel" not in settings or "add_prefix_space=True" in settings or "use_regex=False" in settings:
            raise ValueError("the tokenizer file must be byte-level BPE over the usual pattern, without a normalizer or prefix space")
        model, letters = tokenizer.model, byte_alphabet()
        plain = PieceEncoder(lambda words: [[t.id for t in model.tokenize(w.decode("latin-1").translate(letters))] for w in words])
        _encoders[tokenizer_file, added_tokens] = AddedTokenEncoder(plain, tokenizer) if added_tokens else plain
    return _encoders[tokenizer_file, added_tokens]


MANIFEST = "file string, part long, n_ids long, n_docs long"


def write(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int | None, partitions: int, added_tokens: bool = False) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files below ``folder``; returns a row for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_file, added_tokens)
        ids, doc_ids, counts = [], [], []
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for s in K.slices(batch.column(1)):
                got, n = enc.encode(s)
                if end_id is not None:
                    got, n = np.insert(got, np.cumsum(n), end_id), n + 1
                ids.append(got.astype(np.uint16 if not len(got) or got.max() <= 0xFFFF else np.uint32))
                counts.append(n)
                doc_ids.append(keys[s.lo : s.hi])
        if not doc_ids:
            return
        part = TaskContext.get().partitionId()
        file = f"{folder}/ids-{part:06d}.dac"
        all_ids, all_docs = np.concatenate(ids), np.concatenate(doc_ids)
        runtime.put_file(file, pack(all_ids, all_docs, np.concatenate(counts)))
        yield pa.RecordBatch.from_pydict({"file": [file], "part": [part], "n_ids": [len(all_ids)], "n_docs": [len(all_docs)]})

    ordered = docs.where("doc_id is not null").select("doc_id", "text").repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(runtime.tidy(run), MANIFEST)


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long, n_checked long"


def read_digests(files: DataFrame) -> DataFrame:
    """From the files named in ``files`` (file, part, n_ids): a row for each document.

    ``n_checked`` counts ids (the first, the middle and the last of the document) that a single random
    access found equal to the bulk read.
    """
    # A row for each file, so the running sum over all of them is small.
    starts = files.withColumn("base", F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("file", F.coalesce("base", F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with runtime.RandomFile(file) as source:
                    reader = Reader(source)
                    doc_ids, at = reader.documents()
                    ids = reader.all().astype("<u4")
                    checked = []
                    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                        spots = {a, (a + b) // 2, b - 1} if b > a else set()
                        checked.append(sum(reader.access(p) == int(ids[p]) for p in spots))
                    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(base + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64()), pa.array(checked, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_checked"])

    # One file a task: the number of files is the number of tasks that wrote them.
    spread = starts.repartition(runtime.shuffle_partitions(files.sparkSession), "file")
    return spread.mapInArrow(runtime.tidy(run), DIGEST)


def round_trip(docs: DataFrame, tokenizer_file: str, end_id: int = 2, added_tokens: bool = False) -> DataFrame:
    """Write ``docs`` as files of ids and return what the files say of each document."""
    spark = docs.sparkSession
    runtime.ship(spark)
    folder = runtime.shared_folder(spark, "token-ids")
    files = runtime.stored(write(docs, folder, tokenizer_file, end_id, runtime.shuffle_partitions(spark), added_tokens), "token-files")
    return read_digests(files)
