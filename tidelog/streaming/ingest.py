"""Changelogs as streams: each micro-batch is one commit, and a replayed one changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..store import Store


def ingest(changes: DataFrame, store: Store, checkpoint: str, source: str, order: str | None = None, available_now: bool = True, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Write a stream of operations (key, value and perhaps op) to a store.

    Operations of a micro-batch follow each other by ``order`` (a column, such as an event number), or as they
    come. The store remembers the last micro-batch of each ``source``, so a batch that Spark repeats after a
    failure is left out. Between batches the store compacts what is due: a stream that brings runs faster than they
    are merged waits here, and rate limits of the source (maxFilesPerTrigger and the like) bound a batch.
    """

    def commit(batch: DataFrame, number: int) -> None:
        rows = batch.orderBy(order) if order else batch
        columns = [c for c in ("key", "op", "value") if c in batch.columns]
        store.write_frame(rows.select(*columns), source=source, source_batch=number)
        while store.options.auto_compaction and store.compact_once():
            pass
        if after:
            after(number)

    writer = changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
