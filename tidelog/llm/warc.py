"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some records, then a skippable frame with the
record index and, at the end, the seek table of the seekable format (magic 184D2A5E and 8F92EAB1, sizes of each
frame). The index maps a record identifier to its frame and its offset and length within the decompressed frame:
one record is read by decompressing one frame. Any Zstandard reader sees a plain sequence of WARC/1.1 records.

Pages with equal payloads have one ``response`` record, that of the largest page_id; the others are ``revisit``
records that refer to it and have no payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
LEVEL = 3
_SKIPPABLE_INDEX, _SKIPPABLE_SEEK, _SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_INDEX_ROW = np.dtype([("id", "<i8"), ("frame", "<u4"), ("offset", "<u4"), ("length", "<u4")])
DATE = "2000-01-01T00:00:00Z"


class BundleWriter:
    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self._limit, self._compressor = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._open: list[bytes] = []
        self._open_bytes = self.size = 0
        self._frames: list[bytes] = []
        self._seek: list[tuple[int, int]] = []
        self._index: list[tuple[int, int, int, int]] = []

    def add(self, identifier: int, record: bytes) -> None:
        self._index.append((identifier, len(self._frames), self._open_bytes, len(record)))
        self._open.append(record)
        self._open_bytes += len(record)
        if self._open_bytes >= self._limit:
            self._close_frame()

    def _close_frame(self) -> None:
        if self._open:
            frame = self._compressor.compress(b"".join(self._open))
            self._frames.append(frame)
            self._seek.append((len(frame), self._open_bytes))
            self.size += len(frame)
            self._open, self._open_bytes = [], 0

    def finish(self) -> bytes:
        self._close_frame()
        index = np.array(self._index, _INDEX_ROW)
        index = index[np.argsort(index["id"], kind="stable")].tobytes()
        index = struct.pack("<II", _SKIPPABLE_INDEX, len(index)) + index
        seek = [*self._seek, (len(index), 0)]
        table = b"".join(struct.pack("<II", *x) for x in seek) + struct.pack("<IBI", len(seek), 0, _SEEKABLE)
        return b"".join([*self._frames, index, struct.pack("<II", _SKIPPABLE_SEEK, len(table)), table])


class BundleReader:
    """Random access to a bundle by its footer."""

    def __init__(self, source):
        self._source, self._decompressor = source, zstandard.ZstdDecompressor()
        frames, _, magic = struct.unpack("<IBI", source.read_at(source.size - 9, 9))
        if magic != _SEEKABLE:
            raise ValueError("not a seekable bundle")
        table = np.frombuffer(source.read_at(source.size - 9 - 8 * frames, 8 * frames), "<u4").reshape(-1, 2).astype(np.int64)
        self._starts = np.concatenate([[0], np.cumsum(table[:, 0])])
        index = source.read_at(int(self._starts[-2]), int(table[-1, 0]))[8:]
        self.index = np.frombuffer(index, _INDEX_ROW)
        self._at, self._frame = -1, b""

    def frame(self, k: int) -> bytes:
        if k != self._at:
            a, b = int(self._starts[k]), int(self._starts[k + 1])
            self._frame, self._at = self._decompressor.decompress(self._source.read_at(a, b - a)), k
        return self._frame

    def record(self, identifier: int) -> bytes:
        """The record with this identifier (the first of several)."""
        i = int(np.searchsorted(self.index["id"], identifier))
        if i == len(self.index) or self.index["id"][i] != identifier:
            raise KeyError(identifier)
        return self._record(self.index[i])

    def _record(self, row) -> bytes:
        return self.frame(int(row["frame"]))[int(row["offset"]) : int(row["offset"]) + int(row["length"])]

    def records(self) -> Iterator[tuple[int, bytes]]:
        for i in np.lexsort((self.index["offset"], self.index["frame"])):
            yield int(self.index["id"][i]), self._record(self.index[i])


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def make_record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}", *([f"WARC-Target-URI: {' '.join(url.split())}"] if url else []), f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers_to is None else [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def with_originals(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, payload) with ``original``: the largest page_id of those with an equal payload.

    Only digests are grouped, after a sum in each task, and the groups are stored first: so the pages of a payload that
    a third of all share are split over tasks by Spark when they meet their group.
    """
    keyed = pages.withColumn("key", F.sha1("payload"))
    groups = keyed.groupBy("key").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("key", "original")
    groups = runtime.stored(groups, "originals")
    return keyed.join(groups, "key", "left").select("page_id", "url", "payload", F.coalesce("original", "page_id").alias("original"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write bundles below ``folder`` from pages with their originals; a row (bundle, records) for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, writer, records = TaskContext.get().partitionId(), 0, BundleWriter(), 0

        def close() -> pa.RecordBatch:
            name = f"{folder}/bundle-{part:06d}-{k:04d}.warc.zst"
            runtime.put_file(name, writer.finish())
            return pa.RecordBatch.from_pydict({"bundle": [name], "records": [records]})

        for batch in batches:
            page, url, payload, original = batch.columns
            for i in range(len(batch)):
                data, page_id, first = payload[i].as_py() or b"", page[i].as_py(), original[i].as_py()
                record = make_record(page_id, url[i].as_py(), data, digest_text(hashlib.sha1(data).digest()), None if first == page_id else first)
                writer.add(page_id, record)
                records += 1
                if writer.size >= BUNDLE_BYTES:
                    yield close()
                    k, writer, records = k + 1, BundleWriter(), 0
        if records:
            yield close()

    return pages.mapInArrow(runtime.tidy(run), "bundle string, records long")


DIGEST = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean"


def read_back(bundles: DataFrame) -> DataFrame:
    """A row for each record of the bundles; ``digest_ok``: a response's payload has the digest of its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda urn: int(urn[len("<urn:page:") : -1])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with runtime.RandomFile(name) as source:
                    for identifier, record in BundleReader(source).records():
                        fields, http, payload = parse_record(record)
                        if number(fields["WARC-Record-ID"]) != identifier:
                            raise ValueError(f"{name}: the index gives another record for {identifier}")
                        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                        ok = kind == "revisit" or digest_text(hashlib.sha1(payload).digest()) == digest
                        rows.append((identifier, int(http["Content-Length"]), digest, kind, number(fields["WARC-Refers-To"]) if kind == "revisit" else None, ok))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok"])

    return bundles.repartition(runtime.shuffle_partitions(bundles.sparkSession), "bundle").mapInArrow(runtime.tidy(run), DIGEST)


def archive(pages: DataFrame) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html), and return what the archives say of each.

    A null html is an empty payload; an empty table gives no archive and no row; a very long page is a frame by itself. Rows without a page_id are left out. Rows that share a page_id each have a
    record; with equal payloads and the largest page_id of them all, each is a response.
    """
    spark = pages.sparkSession
    runtime.ship(spark)
    folder = runtime.shared_folder(spark, "warc")
    plain = pages.where("page_id is not null").select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    bundles = runtime.stored(write(with_originals(plain), folder), "warc-bundles")
    return read_back(bundles)
