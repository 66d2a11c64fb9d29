"""Reading and writing sorted runs: Parquet files in log order, pruned by the manifest before Spark opens them."""

from __future__ import annotations

import math
import os
import uuid
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import LOG_SCHEMA, IoError, Options
from .manifest import DataFile, Version, sync_folder

COLUMNS = ["key", "seq", "op", "value", "batch_id"]
_ARROW = pa.schema([pa.field("key", pa.binary(), False), pa.field("seq", pa.int64(), False), pa.field("op", pa.int8(), False), pa.field("value", pa.binary()), pa.field("batch_id", pa.int64(), False)])


def read_files(spark: SparkSession, root: Path, files: list[DataFile]) -> DataFrame:
    """The entries of these files. Page checksums are verified on every read."""
    if not files:
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).option("parquet.page.verify-checksum.enabled", "true").parquet(*[str(root / f.path) for f in files])


def pruned(version: Version, snapshot: int | None = None, begin: bytes | None = None, end: bytes | None = None, inclusive_end: bool = False) -> list[DataFile]:
    """Files that may have entries with seq <= snapshot and a key in the range."""
    out = []
    for f in version.files.values():
        if snapshot is not None and f.min_seq > snapshot:
            continue
        if end is not None and not inclusive_end and f.smallest >= end:
            continue
        if f.overlaps(begin, end):
            out.append(f)
    return sorted(out, key=lambda f: f.file_no)


def _settings(options: Options) -> dict[str, str]:
    out = {"compression": "uncompressed" if options.compression == "none" else options.compression, "parquet.page.size": str(options.block_size * 16), "parquet.page.write-checksum.enabled": "true"}
    if options.filter_policy is not None:
        out |= options.filter_policy.writer_options("key")
    return out


def write_batch(root: Path, rows: list[tuple], file_no: int, sync: bool, options: Options) -> DataFile:
    """A small batch as one log file, written by the driver in log order."""
    ordered = sorted(rows, key=lambda r: (r[0], -r[1], -r[2]))
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ordered, strict=True), _ARROW, strict=True)], schema=_ARROW)
    path = root / "data" / f"{file_no:012d}-log.parquet"
    path.parent.mkdir(parents=True, exist_ok=True)
    temp = path.with_name(f".{uuid.uuid4().hex}.tmp")
    try:
        with temp.open("wb") as f:
            pq.write_table(table, f, compression="none" if options.compression == "none" else "zstd", write_page_checksum=True)
            f.flush()
            if sync:
                os.fsync(f.fileno())
        os.replace(temp, path)
        if sync:
            sync_folder(path.parent)
    except OSError as e:
        raise IoError(str(e)) from e
    seqs = [r[1] for r in rows]
    return DataFile(file_no, 0, f"data/{path.name}", path.stat().st_size, len(rows), ordered[0][0], ordered[-1][0], min(seqs), max(seqs), "log")


def write_runs(root: Path, rows: DataFrame, first_file_no: int, level: int, size: int, options: Options, kind: str = "run") -> list[DataFile]:
    """Write rows as sorted runs of about ``options.max_file_size`` bytes; ``size`` is the expected number of bytes.

    Ranges of keys don't overlap between the files, and all versions of a key are in one file. Each file's
    bounds come from one aggregation over what was written.
    """
    spark = rows.sparkSession
    parts = max(1, math.ceil(size / options.max_file_size))
    folder = f"data/{first_file_no:012d}-{uuid.uuid4().hex[:8]}"
    ranged = rows.select(COLUMNS).repartitionByRange(parts, "key") if parts > 1 else rows.select(COLUMNS).coalesce(1)
    ordered = ranged.sortWithinPartitions("key", F.col("seq").desc(), F.col("op").desc())
    ordered.write.options(**_settings(options)).parquet(str(root / folder))
    written = spark.read.schema(LOG_SCHEMA).parquet(str(root / folder))
    # A row for each file.
    facts = written.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("z"), F.min("seq").alias("low"), F.max("seq").alias("high")).orderBy("a").collect()
    out = []
    for r in facts:
        name = r["file"].rpartition("/")[2]
        out.append(DataFile(first_file_no + len(out), level, f"{folder}/{name}", (root / folder / name).stat().st_size, r["n"], bytes(r["a"]), bytes(r["z"]), r["low"], r["high"], kind))
    sync_folder(root / folder)
    return out
