"""Multi-version reads as functions of DataFrames.

A log has columns key, seq, op (1 put, 0 delete), value and perhaps others; seq is unique. Nothing here knows about
files. Each function is one aggregation or one sort at most; the newest version of a key is chosen before deletes are
dropped, never after, or a deleted key would come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DELETE, PUT
from .ranges import with_range


def up_to(log: DataFrame, snapshot: int | None) -> DataFrame:
    return log if snapshot is None else log.where(F.col("seq") <= snapshot)


def newest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(key, seq, op, value): the newest entry of each key, deletes included.

    The maximum of (seq, op, value) is a partial aggregate: each task sends one row for each key it has, so a key
    with a third of all entries costs the shuffle nothing.
    """
    best = F.max(F.struct("seq", "op", "value")).alias("newest")
    return up_to(log, snapshot).groupBy("key").agg(best).select("key", "newest.seq", "newest.op", "newest.value")


def visible(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(key, value, seq) that a reader at the snapshot sees."""
    return newest(log, snapshot).where(F.col("op") == PUT).select("key", "value", "seq")


def tombstones(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(key, seq) of keys whose newest entry is a delete."""
    return newest(log, snapshot).where(F.col("op") == DELETE).select("key", "seq")


def bounded(rows: DataFrame, begin=None, end=None, column: str = "key") -> DataFrame:
    """Rows with begin <= key < end; either bound may be missing. On a log this reaches the scan."""
    if begin is not None:
        rows = rows.where(F.col(column) >= F.lit(begin))
    if end is not None:
        rows = rows.where(F.col(column) < F.lit(end))
    return rows


def scan(log: DataFrame, snapshot: int | None = None, begin=None, end=None, reverse: bool = False) -> DataFrame:
    """(key, value) in key order. Bounds are applied to the log, before anything is compared."""
    order = F.col("key").desc() if reverse else F.col("key").asc()
    return visible(bounded(log, begin, end), snapshot).select("key", "value").orderBy(order)


def seek(log: DataFrame, target, limit: int = 1, snapshot: int | None = None) -> DataFrame:
    """The first ``limit`` visible rows with key >= target; no row if there is none."""
    return scan(log, snapshot, begin=target).limit(limit)


def seek_before(log: DataFrame, target, limit: int = 1, snapshot: int | None = None) -> DataFrame:
    """The last ``limit`` visible rows with key < target, the largest first."""
    return scan(log, snapshot, end=target, reverse=True).limit(limit)


def lookup(log: DataFrame, probes: DataFrame, snapshot: int | None = None) -> DataFrame:
    """For each distinct probe ``key``: status (found, not_found), reason (deleted, not present) and value.

    Entries of other keys are dropped before versions are compared (a semi-join, which Spark broadcasts when the
    probes are few), so the aggregation sees probed keys only.
    """
    asked = probes.select("key").distinct()
    have = newest(log.join(asked, "key", "left_semi"), snapshot)
    got = asked.join(have, "key", "left")
    found = F.col("op") == PUT
    status = F.when(found, "found").otherwise("not_found")
    reason = F.when(F.col("op").isNull(), "not present").when(F.col("op") == DELETE, "deleted")
    return got.select("key", status.alias("status"), reason.alias("reason"), F.when(found, F.col("value")).alias("value"))


def neighbours(state: DataFrame, buckets: int | None = None) -> DataFrame:
    """(key, previous, next) of each row of a visible state, in key order.

    Keys are dealt into ranges; within a range the neighbours are window functions, and the ends of ranges meet in
    a table with one row for each range. No task sees more than a range and that table.
    """
    n = buckets or int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = with_range(state.select("key"), "key", n)
    w = Window.partitionBy("part").orderBy("key")
    inside = ranged.select("key", "part", F.lag("key").over(w).alias("previous"), F.lead("key").over(w).alias("next"))
    ends = ranged.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    # One row for each range.
    over = Window.orderBy("part")
    joints = ends.select("part", F.lag("high").over(over).alias("before"), F.lead("low").over(over).alias("after"))
    return inside.join(F.broadcast(joints), "part").select("key", F.coalesce("previous", "before").alias("previous"), F.coalesce("next", "after").alias("next"))


def diff(log: DataFrame, earlier: int, later: int) -> DataFrame:
    """(key, change, old, new) of keys that two snapshots see differently: added, removed or changed.

    One pass over the entries up to ``later``: both states are conditional maxima of the same aggregation.
    """
    entry = F.struct("seq", "op", "value")
    both = up_to(log, later).groupBy("key").agg(F.max(entry).alias("b"), F.max(F.when(F.col("seq") <= earlier, entry)).alias("a"))
    seen = lambda c: F.when(F.col(f"{c}.op") == PUT, F.col(f"{c}.value"))
    there = lambda c: F.coalesce(F.col(f"{c}.op") == PUT, F.lit(False))
    flat = both.select("key", there("a").alias("was"), there("b").alias("now"), seen("a").alias("old"), seen("b").alias("new"))
    change = F.when(~F.col("was"), "added").when(~F.col("now"), "removed").otherwise("changed")
    differs = (F.col("was") != F.col("now")) | (F.col("was") & F.col("now") & ~F.col("old").eqNullSafe(F.col("new")))
    return flat.where(differs).select("key", change.alias("change"), "old", "new")


def retained(log: DataFrame, oldest_snapshot: int, is_base_level: Column | bool = True) -> DataFrame:
    """What a compaction keeps. Only the oldest live snapshot S matters.

    An entry goes if the next newer one of its key has seq <= S (no snapshot can see it), and a delete goes if its
    seq <= S and nothing deeper may hold its key (``is_base_level``). So all entries after S stay, and of those up to S
    the newest of each key: an aggregation that sums up in each task, not a window over all versions of a key.
    """
    base = F.lit(is_base_level) if isinstance(is_base_level, bool) else is_base_level
    others = [c for c in log.columns if c not in ("key", "seq", "op")]
    seen = log.where(F.col("seq") <= oldest_snapshot).groupBy("key").agg(F.max(F.struct("seq", "op", *others)).alias("one")).select("key", "one.*")
    seen = seen.where(~((F.col("op") == DELETE) & base))
    return log.where(F.col("seq") > oldest_snapshot).unionByName(seen)


def merge_runs(*runs: DataFrame) -> DataFrame:
    """The union of runs in log order: keys ascending, versions descending, a put before a delete of equal seq."""
    merged = runs[0]
    for r in runs[1:]:
        merged = merged.unionByName(r, allowMissingColumns=True)
    return merged.orderBy("key", F.col("seq").desc(), F.col("op").desc())


def repaired(entries: DataFrame, keep_deletes: bool = False) -> DataFrame:
    """Each key once, at its newest version; of entries with equal key, seq and op that of the lower ``file_no`` counts."""
    best = F.max(F.struct("seq", "op", (-F.col("file_no")).alias("rank"), "value")).alias("best")
    one = entries.groupBy("key").agg(best).select("key", "best.seq", "best.op", "best.value")
    return one if keep_deletes else one.where(F.col("op") == PUT)


def disagreements(entries: DataFrame) -> DataFrame:
    """(key, seq, op) of entries that several files hold with different values."""
    return entries.groupBy("key", "seq", "op").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("some"), F.count("*").alias("n")).where("n > 1 AND (low != high OR (some > 0 AND some < n))").select("key", "seq", "op")


def batches(log: DataFrame) -> DataFrame:
    """(batch_id, entries, first_seq, last_seq, dense) of each batch."""
    grouped = log.groupBy("batch_id").agg(F.count("*").alias("entries"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return grouped.withColumn("dense", F.col("last_seq") - F.col("first_seq") + 1 == F.col("entries"))


def intact_prefix(log: DataFrame, declared: DataFrame) -> DataFrame:
    """Entries of the batches before the first whose entries are not as many as ``declared`` (batch_id, entries)."""
    counted = declared.select("batch_id", F.col("entries").alias("wanted")).join(log.groupBy("batch_id").agg(F.count("*").alias("entries")), "batch_id", "left")
    broken = counted.where(~F.col("wanted").eqNullSafe(F.coalesce("entries", F.lit(0)))).agg(F.min("batch_id").alias("broken"))
    # One row.
    return log.join(F.broadcast(broken), F.coalesce(log["batch_id"] < F.col("broken"), F.col("broken").isNull())).drop("broken")
