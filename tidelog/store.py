"""The store: a folder with a manifest, logs of small batches and sorted runs, read as DataFrames.

Writes are published by one manifest version each, so a batch is seen whole or not at all, by every DataFrame made after
it; a DataFrame made before keeps its files and its snapshot. One process has a store open at a time.
"""

from __future__ import annotations

import contextlib
import fcntl
import shutil
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import DELETE, LEVELS, MAX_SEQ, PUT, Corruption, InvalidArgument, IoError, Options
from .operators import mvcc
from .operators.batch import WriteBatch, group, numbered, placed, validate
from .plans import compaction as plan
from .sources import runs
from .sources.manifest import DataFile, Manifest, Version, level_rows

PREFIX = "tidelog."


class Snapshot:
    """A point in the store's history; opaque to callers."""

    def __init__(self, seq: int):
        self._seq = seq


class Store:
    def __init__(self, spark: SparkSession, root: Path, options: Options, version: Version, lock):
        self.spark, self.root, self.options = spark, root, options
        self._manifest, self._version, self._lock = Manifest(root), version, lock
        self._snapshots: list[Snapshot] = []
        self._error: Exception | None = None
        self._read = {"files": 0, "bytes": 0}

    # --- opening ---------------------------------------------------------------------------------

    @staticmethod
    def open(spark: SparkSession, path: str | Path, options: Options | None = None) -> Store:
        """Open the store in a local folder. Raises if it is damaged, open elsewhere, or not as ``options`` ask."""
        root, options = Path(path), (options or Options()).clamped()
        manifest = Manifest(root)
        there = manifest.exists()
        if there and options.error_if_exists:
            raise InvalidArgument(f"{root} already has a store")
        if not there:
            if (root / "data").is_dir() and any((root / "data").iterdir()):
                raise Corruption(f"{root} has data files but no manifest; repair it")
            if not options.create_if_missing:
                raise InvalidArgument(f"{root} has no store")
            root.mkdir(parents=True, exist_ok=True)
        lock = _locked(root)
        try:
            version = manifest.load() if there else manifest.publish(Version(), [{"set": "last_seq", "value": 0}, {"set": "next_file", "value": 1}])
            missing = [f.path for f in version.files.values() if not (root / f.path).is_file()]
            if missing:
                raise Corruption(f"{len(missing)} data files are missing, {missing[0]} among them")
        except BaseException:
            lock.close()
            raise
        return Store(spark, root, options, version, lock)

    def close(self) -> None:
        self._lock.close()

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def reopened(self) -> Store:
        self.close()
        return Store.open(self.spark, self.root, self.options)

    # --- writing ---------------------------------------------------------------------------------

    def put(self, key: bytes | str, value: bytes | str, sync: bool = False) -> None:
        self.write(WriteBatch().put(key, value), sync)

    def delete(self, key: bytes | str, sync: bool = False) -> None:
        """A key that is not there may be deleted too."""
        self.write(WriteBatch().delete(key), sync)

    def write(self, batch: WriteBatch, sync: bool = False) -> int:
        """Commit a batch; returns the sequence number of its last operation. An empty batch changes nothing."""
        return self.write_group([batch], sync)

    def write_group(self, batches: Iterable[WriteBatch], sync: bool = False) -> int:
        """Commit several batches at once, in order: they become visible together."""
        whole = WriteBatch()
        for b in batches:
            whole.append(b)
        if not len(whole):
            return self.last_sequence
        self._make_room()
        v = self._version
        with self._sticky():
            rows = whole.rows(v.last_seq + 1, v.number + 1)
            file = runs.write_batch(self.root, rows, v.next_file, sync, self.options)
            handed = sum(len(r[0]) + len(r[3] or b"") for r in rows)
            self._commit([{"add": file.to_json()}], {"last_seq": v.last_seq + len(rows), "next_file": v.next_file + 1}, {"log": file.bytes, "handed_in": handed, "records": len(rows), "batches": 1}, sync)
        return self.last_sequence

    def write_queue(self, writers: Iterable[tuple[WriteBatch, bool]]) -> list[int]:
        """Commit queued (batch, sync) writers in groups, each group one commit; the last sequence number of each writer."""
        out = []
        for batches, sync in group(writers):
            at = self.last_sequence
            self.write_group(batches, sync)
            for b in batches:
                at += len(b)
                out.append(at)
        return out

    def write_frame(self, ops: DataFrame, sync: bool = True, source: str | None = None, source_batch: int | None = None) -> int:
        """Commit a DataFrame of operations (key, value and perhaps op; a null value without op deletes) as one batch.

        Its rows are numbered in its own order and go straight to sorted runs. With ``source`` and
        ``source_batch`` a batch that was committed before is left out, so a replay changes nothing.
        """
        v = self._version
        if source is not None and v.values.get(f"source-{source}", -1) >= source_batch:
            return self.last_sequence
        self._make_room()
        v = self._version
        if "op" not in ops.columns:
            ops = ops.withColumn("op", F.when(F.col("value").isNull(), DELETE).otherwise(PUT))
        with self._sticky():
            staged = self.root / "staging" / f"{v.next_file:012d}"
            shutil.rmtree(staged, ignore_errors=True)
            ops.select(F.col("key").cast("binary").alias("key"), F.col("op").cast("tinyint").alias("op"), F.col("value").cast("binary").alias("value")).transform(placed).write.parquet(str(staged))
            rows, facts = numbered(self.spark.read.parquet(str(staged)), v.last_seq + 1, v.number + 1)
            extra = {} if source is None else {f"source-{source}": source_batch}
            if facts.rows:
                size = sum(p.stat().st_size for p in staged.glob("*.parquet"))
                level = plan.flush_level(v, facts.smallest, facts.largest, self.options) if not v.logs() else 0
                files = runs.write_runs(self.root, rows, v.next_file, level, size, self.options)
                # The staged copy is what a log would be.
                counts = {"log": size, "flush": sum(f.bytes for f in files), "handed_in": facts.handed_in, "records": facts.rows, "batches": 1}
                self._commit([{"add": f.to_json()} for f in files], {"last_seq": v.last_seq + facts.rows, "next_file": v.next_file + len(files)} | extra, counts, sync)
            elif extra:
                self._commit([], extra, {}, sync)
            shutil.rmtree(staged, ignore_errors=True)
        return self.last_sequence

    def _make_room(self) -> None:
        """Flush a full tail, and let no more level-0 runs gather than readers should merge."""
        if self._error is not None:
            raise self._error
        if sum(f.bytes for f in self._version.logs()) >= self.options.write_buffer_size:
            self.flush()
        if self.options.auto_compaction:
            while len(self._version.level(0)) >= self.options.level0_slowdown and self.compact_once():
                pass
        elif len(self._version.level(0)) >= self.options.level0_stop:
            self.compact_once()

    def flush(self) -> None:
        """Merge the logs of small batches into one sorted run (several, if it is large)."""
        v = self._version
        logs = v.logs()
        if not logs:
            return
        with self._sticky():
            smallest, largest = min(f.smallest for f in logs), max(f.largest for f in logs)
            level = plan.flush_level(v, smallest, largest, self.options)
            rows = validate(runs.read_files(self.spark, self.root, logs))
            files = runs.write_runs(self.root, rows, v.next_file, level, sum(f.bytes for f in logs), self.options)
            actions = [{"remove": f.file_no} for f in logs] + [{"add": f.to_json()} for f in files]
            self._commit(actions, {"next_file": v.next_file + len(files)}, {"flush": sum(f.bytes for f in files)}, True)

    def _commit(self, actions: list[dict], values: dict, counts: dict[str, int], sync: bool) -> None:
        v = self._version
        values |= {f"count-{k}": v.values.get(f"count-{k}", 0) + n for k, n in counts.items()}
        values["count-manifest"] = v.values.get("count-manifest", 0) + (self._manifest.path(v.number).stat().st_size if v.number else 0)
        if values.get("last_seq", 0) > MAX_SEQ:
            raise InvalidArgument("sequence numbers are used up")
        self._version = self._manifest.publish(v, actions + [{"set": k, "value": x} for k, x in values.items()], sync)

    @contextlib.contextmanager
    def _sticky(self):
        """After a failed write the store only reads: what the failure left behind is not built upon."""
        if self._error is not None:
            raise self._error
        try:
            yield
        except InvalidArgument:
            raise
        except Exception as e:
            self._error = e
            raise

    # --- snapshots -------------------------------------------------------------------------------

    @property
    def last_sequence(self) -> int:
        return self._version.last_seq

    def snapshot(self) -> Snapshot:
        s = Snapshot(self.last_sequence)
        self._snapshots.append(s)
        return s

    def release(self, snapshot: Snapshot) -> None:
        if snapshot not in self._snapshots:
            raise InvalidArgument("the snapshot is not one of this store's, or was released")
        self._snapshots.remove(snapshot)

    def _oldest(self) -> int:
        return min((s._seq for s in self._snapshots), default=self.last_sequence)

    def _at(self, snapshot: Snapshot | None) -> int:
        if snapshot is None:
            return self.last_sequence
        if snapshot not in self._snapshots:
            raise InvalidArgument("the snapshot is not one of this store's, or was released")
        return snapshot._seq

    # --- reading ---------------------------------------------------------------------------------

    def log(self, snapshot: Snapshot | None = None, begin: bytes | None = None, end: bytes | None = None, inclusive_end: bool = False) -> DataFrame:
        """All entries up to the snapshot in a range of keys, from the files that may have some."""
        at = self._at(snapshot)
        files = runs.pruned(self._version, at, begin, end, inclusive_end)
        self._read["files"] += len(files)
        self._read["bytes"] += sum(f.bytes for f in files)
        return mvcc.up_to(validate(runs.read_files(self.spark, self.root, files)), at)

    def state(self, snapshot: Snapshot | None = None, begin: bytes | str | None = None, end: bytes | str | None = None) -> DataFrame:
        """(key, value) visible in [begin, end), in no order."""
        a, z = (x.encode() if isinstance(x, str) else x for x in (begin, end))
        return mvcc.visible(mvcc.bounded(self.log(snapshot, a, z), a, z)).select("key", "value")

    def scan(self, begin: bytes | str | None = None, end: bytes | str | None = None, reverse: bool = False, snapshot: Snapshot | None = None) -> DataFrame:
        """(key, value) visible in [begin, end), in key order."""
        return self.state(snapshot, begin, end).orderBy(F.col("key").desc() if reverse else F.col("key"))

    def seek(self, target: bytes | str, limit: int = 1, snapshot: Snapshot | None = None) -> DataFrame:
        return self.scan(target, snapshot=snapshot).limit(limit)

    def seek_before(self, target: bytes | str, limit: int = 1, snapshot: Snapshot | None = None) -> DataFrame:
        """The last visible keys before the target, the largest first."""
        return self.scan(None, target, reverse=True, snapshot=snapshot).limit(limit)

    def get(self, key: bytes | str, snapshot: Snapshot | None = None) -> bytes | None:
        """The value of one key, or None. For many keys use :meth:`multi_get`: a Spark job costs more than a thousand keys."""
        row = self.get_status(key, snapshot)
        return row["value"]

    def get_status(self, key: bytes | str, snapshot: Snapshot | None = None) -> dict:
        """status, reason and value of one key."""
        k = key.encode() if isinstance(key, str) else bytes(key)
        found = self.log(snapshot, k, k, inclusive_end=True).where(F.col("key") == F.lit(k)).agg(F.max(F.struct("seq", "op", "value")).alias("x")).select("x.*").head()
        if found["op"] is None:
            return {"status": "not_found", "reason": "not present", "value": None}
        if found["op"] == DELETE:
            return {"status": "not_found", "reason": "deleted", "value": None}
        return {"status": "found", "reason": None, "value": bytes(found["value"])}

    def multi_get(self, probes: DataFrame, snapshot: Snapshot | None = None) -> DataFrame:
        """(key, status, reason, value) of each distinct ``key`` of ``probes``; only files within the probes' range are read."""
        asked = probes.select(F.col("key").cast("binary").alias("key"))
        ends = asked.agg(F.min("key").alias("a"), F.max("key").alias("z")).head()
        if ends["a"] is None:
            return mvcc.lookup(runs.read_files(self.spark, self.root, []), asked)
        a, z = bytes(ends["a"]), bytes(ends["z"])
        log = self.log(snapshot, a, z, inclusive_end=True).where(F.col("key").between(F.lit(a), F.lit(z)))
        return mvcc.lookup(log, asked)

    # --- compaction ------------------------------------------------------------------------------

    def compact_once(self) -> bool:
        """Do the compaction that is due most; False if none is.

        The logs are flushed first, so that no older version of a key waits in them when its delete is dropped.
        """
        self.flush()
        job = plan.pick(self._version, self.options)
        if job is None:
            return False
        self._compact(job)
        return True

    def compact_range(self, begin: bytes | str | None = None, end: bytes | str | None = None) -> None:
        """Merge all levels that have keys in [begin, end] down to the deepest of them; None is unbounded."""
        a, z = (x.encode() if isinstance(x, str) else x for x in (begin, end))
        self.flush()
        for level in plan.manual_levels(self._version, a, z):
            low = a
            while inputs := plan.manual_inputs(self._version, level, low, z, self.options):
                top = max(f.largest for f in inputs)
                self._compact(plan.completed(self._version, level, inputs, self.options, manual=True))
                if level == 0:
                    break
                low = top
                if not [f for f in self._version.overlapping(level, low, z) if f.largest > top]:
                    break

    def _compact(self, job: plan.Compaction) -> None:
        v = self._version
        pointer = {f"pointer-{job.level}": max(f.largest for f in job.inputs).hex()} if job.level and not job.manual else {}
        with self._sticky():
            if job.is_move(self.options):
                f = job.inputs[0]
                moved = DataFile(**{**f.__dict__, "level": job.level + 1})
                self._commit([{"remove": f.file_no}, {"add": moved.to_json()}], pointer, {}, True)
                return
            inputs = job.inputs + job.below
            rows = mvcc.retained(validate(runs.read_files(self.spark, self.root, inputs)), self._oldest(), plan.is_base_level(v, job.level, *job.range))
            files = runs.write_runs(self.root, rows, v.next_file, job.level + 1, sum(f.bytes for f in inputs), self.options)
            actions = [{"remove": f.file_no} for f in inputs] + [{"add": f.to_json()} for f in files]
            read, wrote = sum(f.bytes for f in inputs), sum(f.bytes for f in files)
            self._commit(actions, {"next_file": v.next_file + max(1, len(files))} | pointer, {"compaction": wrote, f"read-{job.level + 1}": read, f"write-{job.level + 1}": wrote}, True)

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete data files that none of the newest ``keep_versions`` versions names; returns how many.

        DataFrames made from older versions can't be read afterwards. Refused after a failed write.
        """
        if self._error is not None:
            raise self._error
        numbers = [n for n in self._manifest.numbers() if n <= self._version.number][-max(1, keep_versions) :]
        live = self._manifest.live_paths(numbers)
        gone = 0
        for p in sorted((self.root / "data").rglob("*.parquet")) if (self.root / "data").is_dir() else []:
            if str(p.relative_to(self.root)) not in live and not p.name.startswith("."):
                p.unlink()
                p.with_name(f".{p.name}.crc").unlink(missing_ok=True)
                gone += 1
        for d in (self.root / "data").iterdir() if (self.root / "data").is_dir() else []:
            if d.is_dir() and not any(d.glob("*.parquet")):
                shutil.rmtree(d)
        return gone

    # --- introspection ---------------------------------------------------------------------------

    def files(self) -> DataFrame:
        """The files of the current version, with levels, sizes and bounds."""
        return self._version.as_frame(self.spark)

    def property(self, name: str) -> str | None:
        """A named fact as text; None for a name that is not known."""
        if not name.startswith(PREFIX):
            return None
        name, v = name[len(PREFIX) :], self._version
        count = lambda k: v.values.get(f"count-{k}", 0)
        if name.startswith("num-files-at-level"):
            level = name[len("num-files-at-level") :]
            return str(len(v.level(int(level)))) if level.isdigit() and int(level) < LEVELS else None
        if name == "stats":
            lines = ["level files bytes read written"]
            lines += [f"{n} {files} {size} {count(f'read-{n}')} {count(f'write-{n}')}" for n, files, size in level_rows(v)]
            return "\n".join([*lines, f"total {sum(r[1] for r in level_rows(v))} {sum(r[2] for r in level_rows(v))}"])
        if name == "table-reads":
            return f"reads {self._read['files']}\nbytes {self._read['bytes']}"
        if name == "log-writes":
            return f"records {count('records')}\nbatches {count('batches')}"
        if name == "bytes-written":
            return "\n".join(f"{k} {count(k)}" for k in ("log", "flush", "compaction", "manifest"))
        if name == "sstables":
            lines = []
            for n in range(LEVELS):
                lines += [f"level {n}"] + [f"{f.file_no} {f.bytes} {f.smallest!r} .. {f.largest!r}" for f in v.level(n)]
            return "\n".join(lines)
        if name == "approximate-memory-usage":
            return str(sum(f.bytes for f in v.logs()))
        if name == "last-sequence":
            return str(v.last_seq)
        return None

    def bytes_written(self) -> dict[str, int]:
        return {k: self._version.values.get(f"count-{k}", 0) for k in ("log", "flush", "compaction", "manifest")}

    def bytes_handed_in(self) -> int:
        return self._version.values.get("count-handed_in", 0)

    def approximate_offset(self, key: bytes | str) -> int:
        """Bytes of the files that lie wholly before the key."""
        k = key.encode() if isinstance(key, str) else key
        return sum(f.bytes for f in self._version.files.values() if f.largest < k)


def _locked(root: Path):
    lock = (root / "LOCK").open("a")
    try:
        fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
    except OSError as e:
        lock.close()
        raise IoError(f"{root} is open in another process or by another Store") from e
    return lock


def destroy(path: str | Path) -> None:
    """Delete a store's own files; files it does not know stay, and so does the folder if there are any."""
    root = Path(path)
    if not root.is_dir():
        return
    lock = _locked(root)
    try:
        for d, patterns in (("data", ("*.parquet", ".*.crc", "_SUCCESS", ".*.tmp")), ("manifest", ("*.json", ".*.tmp"))):
            for pattern in patterns:
                for p in (root / d).rglob(pattern) if (root / d).is_dir() else []:
                    p.unlink()
            for p in sorted((root / d).rglob("*"), reverse=True) if (root / d).is_dir() else []:
                if p.is_dir() and not any(p.iterdir()):
                    p.rmdir()
        shutil.rmtree(root / "staging", ignore_errors=True)
        (root / "LOCK").unlink(missing_ok=True)
        for d in (root / "data", root / "manifest", root):
            if d.is_dir() and not any(d.iterdir()):
                d.rmdir()
    finally:
        lock.close()
