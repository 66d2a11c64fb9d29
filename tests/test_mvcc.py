"""Multi-version operators against a plain model."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.model import DELETE, LOG_SCHEMA, PUT
from tidelog.operators import batch as B
from tidelog.operators import mvcc


def random_log(seed, n=3000, keys=200, deletes=0.25):
    rnd = random.Random(seed)
    rows = []
    for seq in range(1, n + 1):
        key = b"key_%08d" % rnd.randrange(keys)
        gone = rnd.random() < deletes
        rows.append((bytearray(key), seq, DELETE if gone else PUT, None if gone else bytearray(b"value_%d" % seq), (seq - 1) // 10))
    return rows


def model(rows, snapshot=None):
    out = {}
    for key, seq, op, value, _ in rows:
        if snapshot is None or seq <= snapshot:
            if op == PUT:
                out[bytes(key)] = bytes(value)
            else:
                out.pop(bytes(key), None)
    return out


def as_dict(df):
    return {bytes(r["key"]): bytes(r["value"]) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    return random_log(20260907)


@pytest.fixture(scope="module")
def log(spark, rows):
    return spark.createDataFrame(rows, LOG_SCHEMA).repartition(4).cache()


@pytest.mark.parametrize("snapshot", [None, 0, 1, 777, 2999])
def test_visible_is_the_model(log, rows, snapshot):
    assert as_dict(mvcc.visible(log, snapshot)) == model(rows, snapshot)


def test_scans_and_seeks(log, rows):
    want = sorted(model(rows).items())
    assert [(bytes(r["key"]), bytes(r["value"])) for r in mvcc.scan(log).collect()] == want
    assert [bytes(r["key"]) for r in mvcc.scan(log, reverse=True).collect()] == [k for k, _ in reversed(want)]
    target = b"key_00000100"
    assert [bytes(r["key"]) for r in mvcc.seek(log, target, 3).collect()] == [k for k, _ in want if k >= target][:3]
    assert [bytes(r["key"]) for r in mvcc.seek_before(log, target).collect()] == [max(k for k, _ in want if k < target)]
    assert mvcc.seek(log, b"zzz").collect() == []
    inside = [bytes(r["key"]) for r in mvcc.scan(log, begin=b"key_00000050", end=b"key_00000060").collect()]
    assert inside == [k for k, _ in want if b"key_00000050" <= k < b"key_00000060"]


def test_neighbours(log, rows):
    keys = sorted(model(rows))
    got = {bytes(r["key"]): (r["previous"] and bytes(r["previous"]), r["next"] and bytes(r["next"])) for r in mvcc.neighbours(mvcc.visible(log)).collect()}
    assert got == {k: (keys[i - 1] if i else None, keys[i + 1] if i + 1 < len(keys) else None) for i, k in enumerate(keys)}


def test_lookup_tells_deleted_from_absent(spark, log, rows):
    state, all_keys = model(rows), {bytes(r[0]) for r in rows}
    probes = sorted(all_keys) + [k + b"-" for k in sorted(all_keys)[:20]]
    frame = spark.createDataFrame([(bytearray(p),) for p in probes * 2], "key binary")
    got = {bytes(r["key"]): (r["status"], r["reason"], r["value"] and bytes(r["value"])) for r in mvcc.lookup(log, frame).collect()}
    want = {p: ("found", None, state[p]) if p in state else ("not_found", "deleted" if p in all_keys else "not present", None) for p in probes}
    assert got == want


@pytest.mark.parametrize("snapshot", [0, 1500, 3000])
def test_retention_changes_nothing_from_the_snapshot_on(log, rows, snapshot):
    kept = mvcc.retained(log, snapshot, False).cache()
    for s in (snapshot, snapshot + 1, 2000, 2999, None):
        if s is None or s >= snapshot:
            assert as_dict(mvcc.visible(kept, s)) == model(rows, s)
    base = mvcc.retained(log, snapshot, True)
    assert as_dict(mvcc.visible(base)) == model(rows)
    assert base.where((F.col("op") == DELETE) & (F.col("seq") <= snapshot)).count() == 0
    if snapshot == 3000:
        assert base.count() == len(model(rows))


def test_diff(log, rows):
    a, b = model(rows, 1000), model(rows, 2500)
    got = {bytes(r["key"]): r["change"] for r in mvcc.diff(log, 1000, 2500).collect()}
    want = {k: "added" if k not in a else "removed" if k not in b else "changed" for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    assert got == want


def test_order_of_entries(spark):
    rows = [(bytearray(b"a"), 1, PUT, bytearray(b""), 0), (bytearray(b"a"), 3, PUT, bytearray(b"x"), 0), (bytearray(b"a"), 2, DELETE, None, 0), (bytearray(b"b"), 1, PUT, bytearray(b"y"), 0), (bytearray(b""), 9, PUT, bytearray(b"z"), 0)]
    log = spark.createDataFrame(rows, LOG_SCHEMA)
    merged = [(bytes(r["key"]), r["seq"]) for r in mvcc.merge_runs(log.limit(2), log.subtract(log.limit(2))).collect()]
    assert merged == [(b"", 9), (b"a", 3), (b"a", 2), (b"a", 1), (b"b", 1)]


def test_bytes_compare_unsigned(spark):
    keys = [b"", b"\x00", b"\x7f", b"\x80", b"\xff", b"\xff\x00", b"a", b"a\x00", b"ab"]
    log = spark.createDataFrame([(bytearray(k), i + 1, PUT, bytearray(b""), 0) for i, k in enumerate(keys)], LOG_SCHEMA)
    assert [bytes(r["key"]) for r in mvcc.scan(log).collect()] == sorted(keys)


def test_repair_merge_takes_the_newest_wherever_it_is(spark):
    rows = [(10, b"alpha", 50, PUT, b"new"), (10, b"beta", 60, DELETE, None), (20, b"alpha", 30, PUT, b"old"), (20, b"beta", 40, PUT, b"b"), (20, b"gamma", 45, PUT, b"g"), (20, b"alpha", 50, PUT, b"copy")]
    frame = spark.createDataFrame([(f, bytearray(k), s, o, v and bytearray(v)) for f, k, s, o, v in rows], "file_no long, key binary, seq long, op int, value binary")
    assert as_dict(mvcc.repaired(frame)) == {b"alpha": b"new", b"gamma": b"g"}
    assert [(bytes(r["key"]), r["seq"]) for r in mvcc.disagreements(frame).collect()] == [(b"alpha", 50)]


def test_intact_prefix(spark, log):
    declared = log.groupBy("batch_id").agg(F.count("*").alias("entries"))
    assert mvcc.intact_prefix(log, declared).count() == log.count()
    assert mvcc.intact_prefix(log.where("seq != 1234"), declared).agg(F.max("seq")).head()[0] == 1230
    assert mvcc.intact_prefix(log.where("batch_id != 7"), declared).agg(F.max("seq")).head()[0] == 70


def test_batches_and_groups(spark):
    batch = B.WriteBatch().put("k", "1").delete("k").put(b"k", b"2")
    assert len(batch) == 3 and batch.approximate_size == 12 + 3 * 3 + 5
    assert as_dict(mvcc.visible(batch.to_frame(spark, 100))) == {b"k": b"2"}
    assert as_dict(mvcc.visible(batch.to_frame(spark, 100), 101)) == {}
    seen = []
    batch.replay(lambda k, v: seen.append((k, v)), lambda k: seen.append(k))
    assert seen == [(b"k", b"1"), b"k", (b"k", b"2")]
    both = B.WriteBatch().append(batch).append(batch)
    assert len(both) == 6
    big = B.WriteBatch().put("x", "y" * 1_100_000)
    assert [len(g) for g, _ in B.group([(batch, False)] * 5)] == [5]
    assert [(len(g), s) for g, s in B.group([(batch, False), (batch, True), (batch, False)])] == [(1, False), (2, True)]
    assert [len(g) for g, _ in B.group([(batch, False), (big, False), (batch, False)])] == [1, 1, 1]
    with pytest.raises(B.Corruption):
        B.check_counts(batch.to_frame(spark), spark.createDataFrame([(1, 4)], "batch_id long, entries long"))
    with pytest.raises(B.InvalidArgument):
        B.WriteBatch().put(1, "x")


def test_validate_rejects_unknown_operations(spark):
    good = B.WriteBatch().put("k", "").delete("k").to_frame(spark)
    assert B.validate(good).count() == 2
    bad = good.withColumn("op", F.lit(7).cast("tinyint"))
    with pytest.raises(Exception, match="malformed"):
        B.validate(bad).collect()
