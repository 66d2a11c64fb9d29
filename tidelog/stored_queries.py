"""Registered queries that go through a real store on disk: writes, flushes, compactions, repair, streams."""

from __future__ import annotations

import json
from itertools import tee
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as base
from .functions import accounting, filters
from .model import Options
from .operators.batch import WriteBatch, heads, validate
from .operators.repair import repair
from .shipping import shared_path, ship
from .store import Store
from .streaming.ingest import ingest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_STATE = base.ORACLES["latest_state"]

#: Keys of a filter, about.
FILTER_KEYS = 100_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> Path:
    return shared_path(spark, name) / "store"


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.mutations(spark, sf_dir).orderBy("seq").select("key", "op", "value")


def _text(state: DataFrame) -> DataFrame:
    return state.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _loaded(spark: SparkSession, sf_dir: str, name: str, parts: int = 5, **options) -> Store:
    """A store that the events were written to in some commits."""
    store = Store.open(spark, _folder(spark, name), Options(create_if_missing=True, **options))
    log = base.mutations(spark, sf_dir)
    last = log.agg(F.max("seq")).head()[0] or 0
    step = max(1, -(-last // parts))
    for k in range(0, last, step):
        store.write_frame(log.where((F.col("seq") > k) & (F.col("seq") <= k + step)).orderBy("seq").select("key", "op", "value"))
    return store


@query(_STATE)
def store_state(spark, sf_dir):
    """Written in several commits and read back."""
    return _text(_loaded(spark, sf_dir, "state", auto_compaction=False).state())


@query(_STATE)
def store_compacted(spark, sf_dir):
    """The same after a compaction of the whole range."""
    store = _loaded(spark, sf_dir, "compacted", auto_compaction=False)
    store.compact_range()
    return _text(store.state())


@query(_STATE)
def store_frame_order(spark, sf_dir):
    """One commit of a DataFrame whose partitions differ much in size: of a key's rows the last one counts."""
    store = Store.open(spark, _folder(spark, "order"), Options(create_if_missing=True, auto_compaction=False))
    log = base.mutations(spark, sf_dir)
    last = log.agg(F.max("seq")).head()[0] or 0
    cuts = [0, last // 100, last // 20, last - last // 20, last - last // 100, last]
    pieces = [log.where((F.col("seq") > a) & (F.col("seq") <= z)).orderBy("seq").select("key", "op", "value") for a, z in zip(cuts, cuts[1:], strict=False)]
    ops = pieces[0]
    for p in pieces[1:]:
        ops = ops.union(p)
    store.write_frame(ops)
    return _text(store.state())


@query(_STATE)
def store_deletes(spark, sf_dir):
    """Old values that wait in logs while compactions drop the deletes that came after them."""
    store = Store.open(spark, _folder(spark, "deletes"), Options(create_if_missing=True, auto_compaction=False))
    log = base.mutations(spark, sf_dir)
    for r in log.where("op = 0").select("key").distinct().orderBy("key").limit(20).collect():
        store.put(r["key"], "old")
    last = log.agg(F.max("seq")).head()[0] or 0
    step = max(1, -(-last // 5))
    for k in range(0, last, step):
        store.write_frame(log.where((F.col("seq") > k) & (F.col("seq") <= k + step)).orderBy("seq").select("key", "op", "value"))
    while store.compact_once():
        pass
    return _text(store.state())


@query(base.ORACLES["multi_get_status"])
def store_multi_get(spark, sf_dir):
    """Batched lookups against a store with Bloom filters on its keys."""
    store = _loaded(spark, sf_dir, "multi-get", filter_policy=filters.BloomPolicy(expected_keys=10_000))
    keys = base.mutations(spark, sf_dir).select("key").distinct()
    found = store.multi_get(keys.union(keys.select(F.concat("key", F.lit("-")))))
    return found.select(F.col("key").cast("string").alias("key"), "status", "reason", F.col("value").cast("string").alias("value"))


@query(base.ORACLES["as_of_snapshot"])
def store_snapshot(spark, sf_dir):
    """A snapshot taken between two commits, read after later commits and a compaction."""
    store = Store.open(spark, _folder(spark, "snapshot"), Options(create_if_missing=True, auto_compaction=False))
    log = base.mutations(spark, sf_dir)
    store.write_frame(log.where(F.col("seq") <= base.EARLY).orderBy("seq").select("key", "op", "value"))
    snapshot = store.snapshot()
    store.write_frame(log.where(F.col("seq") > base.EARLY).orderBy("seq").select("key", "op", "value"))
    store.compact_range()
    return _text(store.state(snapshot))


@query(_STATE)
def store_repaired(spark, sf_dir):
    """A store whose manifest was lost, rebuilt from its files."""
    store = _loaded(spark, sf_dir, "repaired", auto_compaction=False)
    store.close()
    for p in (store.root / "manifest").iterdir():
        p.unlink()
    repair(spark, store.root)
    return _text(Store.open(spark, store.root).state())


@query(_STATE)
def stream_ingest(spark, sf_dir):
    """The events as a stream of files, each micro-batch a commit."""
    root = _folder(spark, "stream")
    source = root.parent / "changes"
    log = base.mutations(spark, sf_dir)
    for k in range(3):
        log.where((F.col("seq") > 4000 * k) & ((F.col("seq") <= 4000 * (k + 1)) | (k == 2))).coalesce(1).write.mode("append").parquet(str(source))
    store = Store.open(spark, root, Options(create_if_missing=True))
    changes = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    ingest(changes, store, str(root.parent / "checkpoint"), "events", order="seq").awaitTermination()
    return _text(store.state())


@query()
def repair_report(spark, sf_dir):
    """What repair says of a store with one damaged file."""
    store = _loaded(spark, sf_dir, "report", auto_compaction=False)
    store.close()
    victim = sorted((store.root / "data").rglob("*.parquet"))[0]
    victim.write_bytes(victim.read_bytes()[:-40])
    victim.with_name(f".{victim.name}.crc").unlink(missing_ok=True)
    for p in (store.root / "manifest").iterdir():
        p.unlink()
    return repair(spark, store.root).as_frame(spark)


@query()
def amplification(spark, sf_dir):
    """Bytes written and kept for each byte handed in, after a full compaction."""
    store = _loaded(spark, sf_dir, "amplification")
    store.compact_range()
    store.vacuum()
    disk = sum(p.stat().st_size for p in (store.root / "data").rglob("*.parquet"))
    ratios = accounting.amplification(store.bytes_written(), store.bytes_handed_in(), disk)
    return spark.createDataFrame(sorted(ratios.items()), "kind string, ratio double")


@query()
def properties(spark, sf_dir):
    """Every property of a loaded store."""
    store = _loaded(spark, sf_dir, "properties")
    names = [*(f"num-files-at-level{n}" for n in range(8)), "stats", "table-reads", "log-writes", "bytes-written", "sstables", "approximate-memory-usage", "last-sequence", "unknown"]
    return spark.createDataFrame([(n, store.property(f"tidelog.{n}")) for n in names], "name string, value string")


@query()
def group_commit(spark, sf_dir):
    """Queued writers folded into groups: each batch of the events is a writer, every seventh asks for sync."""
    size = F.sum(WriteBatch.OVERHEAD + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))) + WriteBatch.HEADER
    queue = validate(base.mutations(spark, sf_dir)).groupBy("batch_id").agg(F.count("op").alias("operations"), size.alias("bytes"))
    # One partition of the queue at a time; a row for each group is kept.
    writers, sizes = tee((r["operations"], r["bytes"], r["batch_id"] % 7 == 0) for r in queue.orderBy("batch_id").toLocalIterator())
    groups: list[list] = []
    for (operations, _, sync), head in zip(writers, heads((b, s) for _, b, s in sizes), strict=True):
        if head:
            groups.append([len(groups), 0, 0, sync])
        groups[-1][1] += 1
        groups[-1][2] += operations
    return spark.createDataFrame(groups, "number long, batches long, operations long, sync boolean")


@query()
def bloom_false_positives(spark, sf_dir):
    """Of keys that lie between present ones, how many filters of ten bits a key let through; each filter has about FILTER_KEYS keys."""
    ship(spark)
    policy = filters.BloomPolicy(10)
    keys = base.mutations(spark, sf_dir).select("key").distinct()
    n = max(1, -(-keys.count() // FILTER_KEYS))

    def probe(part: pa.Table) -> pa.Table:
        own = [k.encode() for k in part.column("key").to_pylist()]
        made = policy.create(own)
        missed = sum(not policy.may_match(k, made) for k in own)
        passed = sum(policy.may_match(k + b"-", made) for k in own)
        return pa.table({"keys": [len(own)], "missed": [missed], "passed": [passed], "bits": [8 * len(made)]})

    dealt = keys.withColumn("filter", F.pmod(F.xxhash64("key"), F.lit(n)))
    probed = dealt.groupBy("filter").applyInArrow(probe, "keys long, missed long, passed long, bits long")
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("keys", "missed", "passed", "bits")]
    text = F.format_string(json.dumps({"bits": "%d", "probes": policy.probes}).replace('"%d"', "%d"), "bits")
    return probed.agg(*total).select("keys", "missed", "passed", text.alias("filter"))
