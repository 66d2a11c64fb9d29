"""Findings by place: what is learnt of a row is kept by its file and its number in that file.

Later scans of the same files read the findings beside the rows, so texts need no shuffle and no key. Places
come from the reader itself (file path and row index), whatever the split of files into tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from . import textkit as K

#: Rows of the input whose findings share a file.
CHUNK = 1 << 14


class Lost(Exception):
    """A file that was written is not there, or is not whole."""


class Sidecar:
    """Rows of numbers by place (file, row) in the input, in small files of the shared folder.

    A list beside them names every file with its size, so a file that gets lost is an error and not a place
    without findings.
    """

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names

    @staticmethod
    def write(found: DataFrame, purpose: str) -> Sidecar:
        """``found`` has f and r (the place) and other long columns. The largest file has what is found in CHUNK rows."""
        spark = found.sparkSession
        names = [c for c in found.columns if c not in ("f", "r")]
        side = Sidecar(runtime.shared_folder(spark, purpose), names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            at, written = (0, 0), []

            def close() -> None:
                nonlocal held
                if held:
                    data = np.concatenate(held).astype("<i8").tobytes()
                    runtime.put_file(side._file(*at), data)
                    written.append((*at, len(data)))
                    held = []

            for batch in batches:
                rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
                chunk = rows[:, 1] // CHUNK
                edges = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (chunk[1:] != chunk[:-1])) + 1
                for part in np.split(rows, edges):
                    if len(part):
                        here = (int(part[0, 0]), int(part[0, 1]) // CHUNK)
                        if here != at:
                            close()
                            at = here
                        held.append(part[:, 1:])
            close()
            yield pa.RecordBatch.from_pydict(dict(zip(("f", "chunk", "bytes"), np.array(written, np.int64).reshape(-1, 3).T, strict=True)))

        order = found.select(*(F.col(c).cast("long") for c in ("f", "r", *names)))
        dealt = order.repartition(runtime.shuffle_partitions(spark), "f", F.floor(F.col("r") / CHUNK)).sortWithinPartitions("f", "r")
        # A row for each file of the sidecar, one for CHUNK rows of the input at most.
        files = sorted(tuple(r) for r in dealt.mapInArrow(runtime.tidy(run), "f long, chunk long, bytes long").collect())
        runtime.put_file(f"{side.folder}/list", np.array(files, "<i8").tobytes())
        return side

    def _file(self, f: int, chunk: int) -> str:
        return f"{self.folder}/{f & 0xFFFFFFFFFFFFFFFF:016x}-{chunk:08d}"

    def reader(self) -> Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """A function of a file and ascending rows: (index into the rows, numbers) of all that was found there."""
        kept: dict[tuple[int, int], np.ndarray] = {}
        width = 1 + len(self.names)

        def read(name: str) -> np.ndarray:
            try:
                with runtime.RandomFile(name) as source:
                    return np.frombuffer(source.read_at(0, source.size), "<i8")
            except FileNotFoundError as e:
                raise Lost(name) from e

        listed = read(f"{self.folder}/list").reshape(-1, 3)

        def load(f: int, chunk: int) -> np.ndarray:
            if (f, chunk) not in kept:
                if len(kept) > 4:
                    kept.clear()
                a, z = np.searchsorted(listed[:, 0], f, "left"), np.searchsorted(listed[:, 0], f, "right")
                at = a + np.searchsorted(listed[a:z, 1], chunk)
                if at < z and listed[at, 1] == chunk:
                    numbers = read(self._file(f, chunk))
                    if numbers.nbytes != listed[at, 2]:
                        raise Lost(f"{self._file(f, chunk)} has {numbers.nbytes} bytes of {listed[at, 2]}")
                    kept[f, chunk] = numbers.reshape(-1, width)
                else:
                    kept[f, chunk] = np.zeros((0, width), np.int64)
            return kept[f, chunk]

        def find(f: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            index, numbers = [np.zeros(0, np.int64)], [np.zeros((0, width - 1), np.int64)]
            for chunk in K.distinct(rows // CHUNK).tolist():
                table = load(f, chunk)
                place = np.searchsorted(rows, table[:, 0])
                hit = (place < len(rows)) & (rows[np.minimum(place, len(rows) - 1)] == table[:, 0])
                index.append(place[hit])
                numbers.append(table[hit, 1:])
            return np.concatenate(index), np.concatenate(numbers)

        return find


def place(docs: DataFrame) -> list:
    """The place of a row, as columns; a column of ``docs`` that is called like the reader's own stays a plain column."""
    source = docs.metadataColumn("_metadata")
    return [F.xxhash64(source["file_path"]).alias("__f"), source["row_index"].alias("__r")]


def at_rest(docs: DataFrame) -> DataFrame:
    """``docs`` if it reads Parquet files as they are, else a stored copy that does."""
    try:
        docs.select(*place(docs))
    except AnalysisException as e:
        if "_metadata" not in str(e):
            raise
        return runtime.stored(docs, "texts")
    return docs


def files_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(file, row numbers, rows) of the stretches of a batch that lie in one file; its first columns are the place."""
    files, numbers = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    edges = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(batch)]
    for a, b in zip(edges, edges[1:], strict=False):
        if a < b:
            yield int(files[a]), numbers[a:b], batch.slice(a, b - a)


def scan(docs: DataFrame, work: Callable[[K.Slice, int, np.ndarray], dict | None], schema: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``work`` to slices of the texts of ``docs``, with their file and row numbers; it returns columns.

    Where ``work`` returns a row for each row, columns of ``docs`` can come ``also``, after its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, numbers, part in files_of(batch):
                for s in K.slices(part.column(2)):
                    got = work(s, f, numbers[s.lo : s.hi])
                    if got is not None:
                        yield pa.RecordBatch.from_pydict(got | {name: part.column(3 + k).slice(s.lo, s.hi - s.lo) for k, name in enumerate(also)})

    return docs.select(*place(docs), docs["text"], *(docs[c] for c in also)).mapInArrow(runtime.tidy(run), schema)


def scan_beside(docs: DataFrame, side: Sidecar, work: Callable[[K.Slice, int, np.ndarray, np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """Like :func:`scan`, for the rows alone of which ``side`` has findings: ``work`` also gets rows (in the slice) and numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = side.reader()
        for batch in batches:
            for f, numbers, part in files_of(batch):
                row, found = find(f, numbers)
                if not len(row):
                    continue
                wanted = K.distinct(row.copy())
                row, numbers = np.searchsorted(wanted, row), numbers[wanted]
                for s in K.slices(part.column(2).take(pa.array(wanted))):
                    mine = (row >= s.lo) & (row < s.hi)
                    yield pa.RecordBatch.from_pydict(work(s, f, numbers[s.lo : s.hi], row[mine] - s.lo, found[mine]))

    return docs.select(*place(docs), docs["text"]).mapInArrow(runtime.tidy(run), schema)
