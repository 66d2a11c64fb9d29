"""Repair: make a store of the files that survive, without its manifest.

Every data file is read and checked, each by one task; what can't be read, or is out of order, is set aside in ``lost/``. Of what is
left each key is kept once, at its newest version; deleted keys are left out. The result is one level of runs that is
opened again to prove it. A key whose delete was compacted away before an older version of it was set free can come
back: nothing that survives says that it was deleted.
"""

from __future__ import annotations

import shutil
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import DELETE, LEVELS, LOG_SCHEMA, MAX_SEQ, PUT, Corruption, IoError, Options, StoreError
from ..shipping import ship
from ..sources import runs
from ..sources.manifest import DataFile, Manifest, Version
from . import mvcc


@dataclass
class Report:
    files_found: int = 0
    files_used: int = 0
    files_lost: int = 0
    entries_read: int = 0
    entries_kept: int = 0
    disagreements: int = 0
    last_sequence: int = 0
    notes: list[str] = field(default_factory=list)

    def as_frame(self, spark: SparkSession) -> DataFrame:
        kinds = [T.StructField(k, T.ArrayType(T.StringType()) if k == "notes" else T.LongType()) for k in asdict(self)]
        return spark.createDataFrame([tuple(asdict(self).values())], T.StructType(kinds))


CHECKED = "name string, wrong string, entries long, smallest binary, largest binary, max_seq long"


def _check(path: Path, name: str) -> tuple:
    """A row of CHECKED for one file, read a row group at a time with its checksums; ``wrong`` is null if it is whole."""
    entries, last, smallest, low, high = 0, None, None, None, None
    try:
        f = pq.ParquetFile(path, page_checksum_verification=True)
        if not {"key", "seq", "op", "value", "batch_id"} <= set(f.schema_arrow.names):
            return (name, "its columns are not those of a log", 0, None, None, None)
        for k in range(f.num_row_groups):
            columns = [f.read_row_group(k).column(c).to_pylist() for c in ("key", "seq", "op", "value")]
            for key, seq, op, value in zip(*columns, strict=True):
                at = (key, -seq, -op)
                if last is not None and not last < at:
                    return (name, "its entries are out of order", 0, None, None, None)
                if op not in (DELETE, PUT) or (value is None) != (op == DELETE) or not 0 <= seq <= MAX_SEQ:
                    return (name, f"its entry at seq {seq} is malformed", 0, None, None, None)
                smallest = key if last is None else smallest
                low, high = min(seq, seq if low is None else low), max(seq, seq if high is None else high)
                last = at
                entries += 1
    except Exception as e:  # any way in which a damaged file can fail
        return (name, f"{type(e).__name__}: {e}", 0, None, None, None)
    if name.endswith("-log.parquet") and entries and high - low + 1 != entries:
        return (name, "its batch has not all its sequence numbers", 0, None, None, None)
    return (name, None, entries, smallest, last[0] if last else None, high)


def checked(spark: SparkSession, root: Path, names: list[str]) -> DataFrame:
    """A row of CHECKED for each file; files are dealt over the cluster, which sees the store's folder."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("name", pa.string()), ("wrong", pa.string()), ("entries", pa.int64()), ("smallest", pa.binary()), ("largest", pa.binary()), ("max_seq", pa.int64())])
        for batch in batches:
            rows = [_check(root / name, name) for name in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.createDataFrame([(n,) for n in names], "name string").repartition(min(parts, max(1, len(names))), "name").mapInArrow(run, CHECKED)


def repair(spark: SparkSession, path: str | Path, options: Options | None = None) -> Report:
    """Rebuild the store in ``path``; raises IoError if it is open."""
    from ..store import Store, _locked

    root, options, report = Path(path), (options or Options()).clamped(), Report()
    if not root.is_dir():
        raise IoError(f"{root} is no folder")
    lock = _locked(root)
    try:
        found = sorted(p for p in (root / "data").rglob("*.parquet") if not p.name.startswith(".")) if (root / "data").is_dir() else []
        report.files_found = len(found)
        lost: list[Path] = []
        numbers: dict[str, int] = {}
        entries = None
        names = [str(p.relative_to(root)) for p in found]
        # A row for each file.
        for r in checked(spark, root, names).orderBy("name").collect() if names else []:
            if r["wrong"]:
                lost.append(root / r["name"])
                report.notes.append(f"{r['name']}: {r['wrong']}")
            else:
                numbers[r["name"]] = len(numbers) + 1
                report.entries_read += r["entries"]
                report.last_sequence = max(report.last_sequence, r["max_seq"] or 0)
        if numbers:
            listed = spark.createDataFrame([(k.rpartition("/")[2], v) for k, v in numbers.items()], "name string, file_no long")
            raw = spark.read.schema(LOG_SCHEMA).parquet(*[str(root / k) for k in numbers])
            raw = raw.select("*", F.col("_metadata.file_name").alias("name"))
            # A row for each file.
            entries = raw.join(F.broadcast(listed), "name").drop("name")
        report.files_used, report.files_lost = len(numbers), len(lost)
        files: list[DataFile] = []
        first = int(time.time())  # above every number that was used
        if entries is not None:
            clash = mvcc.disagreements(entries)
            report.disagreements = clash.count()
            if report.disagreements:
                report.notes += [f"{bytes(r['key'])!r} at {r['seq']}: files disagree, the lower-numbered counts" for r in clash.orderBy("key", "seq", "op").toLocalIterator()]
            merged = mvcc.repaired(entries).withColumn("batch_id", F.lit(1).cast("long"))
            size = sum((root / k).stat().st_size for k in numbers)
            files = runs.write_runs(root, merged, first, LEVELS - 1, size, options)
            report.entries_kept = sum(f.entries for f in files)
        aside = root / "lost"
        old = root / "manifest"
        if old.is_dir():
            aside.mkdir(exist_ok=True)
            shutil.move(old, aside / f"manifest-{first}")
        values = {"last_seq": report.last_sequence, "next_file": first + len(files) + 1}
        Manifest(root).publish(Version(), [{"add": f.to_json()} for f in files] + [{"set": k, "value": v} for k, v in values.items()])
        # Only now that the new manifest is in place.
        for p in lost:
            aside.mkdir(exist_ok=True)
            shutil.move(p, aside / f"{p.parent.name}-{p.name}")
        for name in numbers:
            (root / name).unlink()
    finally:
        lock.close()
    with Store.open(spark, root, options) as store:
        if store.state().count() != report.entries_kept:
            raise Corruption("the repaired store does not read back what was kept")
    return report


def needs_repair(spark: SparkSession, path: str | Path) -> bool:
    """Whether the store can't be opened as it is."""
    from ..store import Store

    try:
        Store.open(spark, path).close()
    except IoError:
        raise
    except StoreError:
        return True
    return False
