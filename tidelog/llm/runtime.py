"""What every operator here needs from the session: shipped code, a shared folder, and partition counts."""

from __future__ import annotations

import ctypes
import functools
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import shipping
from ..shipping import shared_folder as shared_folder

#: Bytes of a batch between Spark and its Python workers, where the session has Spark's own default.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, and bound the bytes of a batch: Spark bounds its rows, but texts may be long."""
    shipping.ship(spark)
    name, usual, bound = BATCH
    if spark.conf.get(name, usual) in (usual, "64m", "64MB", "67108864"):
        spark.conf.set(name, bound)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, the work of a task, with its freed memory given back at the end: a worker waits for its next task small."""

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: later steps start from those files."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _filesystem(url: str):
    if "://" not in url and not url.startswith("file:"):
        return None, url
    if url.startswith("file:"):
        return None, "/" + url[len("file:") :].lstrip("/")
    from pyarrow import fs

    return fs.FileSystem.from_uri(url)


def put_file(url: str, data: bytes) -> None:
    """Write a whole file; a task that runs twice replaces it by the same bytes, and no reader sees half of it."""
    fs, path = _filesystem(url)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    if fs is None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(temp, "wb") as f:
            f.write(data)
        os.replace(temp, path)
        return
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(temp) as f:
        f.write(data)
    fs.move(temp, path)


class RandomFile:
    """Positional reads of a file in the shared folder."""

    def __init__(self, url: str):
        fs, path = _filesystem(url)
        self._file = open(path, "rb") if fs is None else fs.open_input_file(path)
        self._file.seek(0, 2)
        self.size = self._file.tell()

    def read_at(self, offset: int, n: int) -> bytes:
        self._file.seek(offset)
        return self._file.read(n)

    def close(self) -> None:
        self._file.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()
