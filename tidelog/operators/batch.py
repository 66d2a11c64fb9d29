"""Write batches: operations that become visible together, in order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DELETE, LOG_SCHEMA, MAX_SEQ, PUT, Corruption, InvalidArgument


def _bytes(x: bytes | str) -> bytes:
    if isinstance(x, str):
        return x.encode()
    if isinstance(x, (bytes, bytearray, memoryview)):
        return bytes(x)
    raise InvalidArgument(f"keys and values are bytes or text, not {type(x).__name__}")


class WriteBatch:
    """An ordered list of puts and deletes. Later operations on a key win; all are kept."""

    #: Bytes of a batch without operations, and of each operation besides its key and value.
    HEADER, OVERHEAD = 12, 3

    def __init__(self):
        self._ops: list[tuple[int, bytes, bytes | None]] = []
        self._size = self.HEADER

    def put(self, key: bytes | str, value: bytes | str) -> WriteBatch:
        return self._add(PUT, _bytes(key), _bytes(value))

    def delete(self, key: bytes | str) -> WriteBatch:
        return self._add(DELETE, _bytes(key), None)

    def _add(self, op: int, key: bytes, value: bytes | None) -> WriteBatch:
        self._ops.append((op, key, value))
        self._size += self.OVERHEAD + len(key) + len(value or b"")
        return self

    def append(self, other: WriteBatch) -> WriteBatch:
        """The operations of ``other`` after those of this batch."""
        self._ops += list(other._ops)
        self._size += other._size - self.HEADER
        return self

    def clear(self) -> None:
        self.__init__()

    def __len__(self) -> int:
        return len(self._ops)

    @property
    def approximate_size(self) -> int:
        return self._size

    def replay(self, put: Callable[[bytes, bytes], None], delete: Callable[[bytes], None]) -> None:
        for op, key, value in self._ops:
            put(key, value) if op == PUT else delete(key)

    def rows(self, first_seq: int, batch_id: int) -> list[tuple[bytes, int, int, bytes | None, int]]:
        """Log rows with consecutive sequence numbers from ``first_seq``."""
        if first_seq + len(self._ops) - 1 > MAX_SEQ:
            raise InvalidArgument("sequence numbers are used up")
        return [(key, first_seq + i, op, value, batch_id) for i, (op, key, value) in enumerate(self._ops)]

    def to_frame(self, spark: SparkSession, first_seq: int = 1, batch_id: int = 1) -> DataFrame:
        rows = [(bytearray(k), s, op, None if v is None else bytearray(v), b) for k, s, op, v, b in self.rows(first_seq, batch_id)]
        return spark.createDataFrame(rows, LOG_SCHEMA)


def heads(writers: Iterable[tuple[int, bool]], most: int = 1 << 20, small: int = 128 << 10) -> Iterator[bool]:
    """For each queued (bytes, sync) writer, whether it begins a group; see :func:`group`."""
    size, limit, synced = 0, -1, False
    for own, sync in writers:
        head = size + own > limit or (sync and not synced)
        if head:
            size, synced = own, sync
            limit = size + small if size <= small else most
        else:
            size += own
        yield head


def group(writers: Iterable[tuple[WriteBatch, bool]], most: int = 1 << 20, small: int = 128 << 10) -> list[tuple[list[WriteBatch], bool]]:
    """Fold queued (batch, sync) writers into groups that are committed together.

    A group grows to ``most`` bytes, or, if its first batch has at most ``small``, to that batch's size and ``small``
    more. A writer that asks for sync joins no group whose first does not.
    """
    writers = list(writers)
    groups: list[tuple[list[WriteBatch], bool]] = []
    for (batch, sync), head in zip(writers, heads(((b.approximate_size, s) for b, s in writers), most, small), strict=True):
        if head:
            groups.append(([batch], sync))
        else:
            groups[-1][0].append(batch)
    return groups


def validate(log: DataFrame) -> DataFrame:
    """``log`` itself, where each row is checked when it is read: known op, value for a put alone, key and seq in range."""
    good = F.col("key").isNotNull() & F.col("seq").between(0, MAX_SEQ) & F.when(F.col("op") == PUT, F.col("value").isNotNull()).when(F.col("op") == DELETE, F.col("value").isNull()).otherwise(False)
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("malformed log row at seq "), F.coalesce(F.col("seq").cast("string"), F.lit("null")))).cast("tinyint"))
    return log.withColumn("op", checked)


def check_counts(log: DataFrame, declared: DataFrame) -> None:
    """Raise Corruption if a batch has not as many rows as ``declared`` (batch_id, entries)."""
    have = log.groupBy("batch_id").agg(F.count("*").alias("have"))
    bad = declared.join(have, "batch_id", "full").where(~F.col("entries").eqNullSafe(F.col("have"))).head()
    if bad is not None:
        raise Corruption(f"batch {bad['batch_id']} declares {bad['entries']} operations and has {bad['have']}")


class Facts(NamedTuple):
    """What a DataFrame of operations amounts to."""

    rows: int
    smallest: bytes | None
    largest: bytes | None
    handed_in: int


def placed(ops: DataFrame) -> DataFrame:
    """``ops`` with ``__at``: the partition and the number of each row within it, to be stored with the rows."""
    return ops.withColumn("__at", F.monotonically_increasing_id())


def numbered(ops: DataFrame, first_seq: int, batch_id: int) -> tuple[DataFrame, Facts]:
    """Log rows of operations (key, op, value, ``__at``) in the order of :func:`placed`, and what they amount to.

    Rows are counted for each partition they had and numbered within it, so no task sees more than its partition. The
    place must be stored: a table that is read again deals its files out by size, not in the order they were written.
    """
    at = ops.withColumn("__part", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND((1 << 33) - 1))
    size = F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)))
    # A row for each partition.
    parts = at.groupBy("__part").agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("z"), size.alias("bytes")).orderBy("__part").collect()
    total, starts = 0, []
    for r in parts:
        starts.append((r["__part"], total))
        total += r["n"]
    if first_seq + max(0, total - 1) > MAX_SEQ:
        raise InvalidArgument("sequence numbers are used up")
    facts = Facts(total, min((bytes(r["a"]) for r in parts), default=None), max((bytes(r["z"]) for r in parts), default=None), sum(r["bytes"] for r in parts))
    offsets = ops.sparkSession.createDataFrame(starts, "__part long, __start long")
    seq = F.col("__start") + F.col("__row") + first_seq
    rows = at.join(F.broadcast(offsets), "__part").select("key", seq.alias("seq"), F.col("op").cast("tinyint").alias("op"), "value", F.lit(batch_id).cast("long").alias("batch_id"))
    return rows, facts
