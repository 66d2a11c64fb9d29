"""The data model: schemas, limits, options and errors.

Every stored entry is (key, seq, op, value): keys and values are bytes, ``seq`` is a logical clock that only grows, ``op`` is
PUT or DELETE. What a reader at snapshot S sees of a key is its newest entry with seq <= S, unless that is a
DELETE. An empty value is a value; a DELETE has null.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import types as T

DELETE, PUT = 0, 1
#: Sequence numbers have 56 bits.
MAX_SEQ = (1 << 56) - 1
LEVELS = 7
#: Recorded in every manifest; a store ordered otherwise is refused.
COMPARATOR = "bytewise"

LOG_SCHEMA = T.StructType([
    T.StructField("key", T.BinaryType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("op", T.ByteType(), False),
    T.StructField("value", T.BinaryType(), True),
    T.StructField("batch_id", T.LongType(), False),
])
STATE_SCHEMA = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType(), True)])
FILES_SCHEMA = T.StructType([
    T.StructField("file_no", T.LongType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("path", T.StringType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("entries", T.LongType()),
    T.StructField("smallest", T.BinaryType()),
    T.StructField("largest", T.BinaryType()),
    T.StructField("min_seq", T.LongType()),
    T.StructField("max_seq", T.LongType()),
])


class StoreError(Exception):
    """Base of the errors that a store reports. A key that is not there is a result, not an error."""


class Corruption(StoreError):
    """Stored data contradicts itself or its record."""


class IoError(StoreError):
    """A file could not be read or written."""


class InvalidArgument(StoreError):
    """The caller asked for something that has no meaning."""


class NotSupported(StoreError):
    """A format or setting that this version does not know."""


KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30

# The limits within which options are brought silently.
LIMITS = {"write_buffer_size": (64 * KIB, GIB), "max_file_size": (MIB, GIB), "block_size": (KIB, 4 * MIB), "max_open_files": (20, None)}


@dataclass(frozen=True)
class Options:
    """How a store is opened. Sizes outside their limits are brought to the nearest limit."""

    create_if_missing: bool = False
    error_if_exists: bool = False
    write_buffer_size: int = 4 * MIB
    max_file_size: int = 2 * MIB
    block_size: int = 4 * KIB
    max_open_files: int = 1000
    #: Parquet codec: zstd, snappy, lz4_raw, gzip or none.
    compression: str = "zstd"
    #: A filter policy (tidelog.functions.filters) or None.
    filter_policy: object | None = None
    #: Level-0 files from which a compaction is due, writes are slowed, and writes wait for a compaction.
    level0_compaction: int = 4
    level0_slowdown: int = 8
    level0_stop: int = 12
    level1_bytes: int = 10 * MIB
    #: Compactions run inside writes when due; else only on request.
    auto_compaction: bool = True

    def clamped(self) -> Options:
        changes = {}
        for f in fields(self):
            if f.name in LIMITS:
                low, high = LIMITS[f.name]
                value = max(low, getattr(self, f.name))
                changes[f.name] = value if high is None else min(high, value)
        return replace(self, **changes)
