"""The store on disk: a dictionary as model, reopening, compaction, recovery, repair, streams, counters."""

import random
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidelog.__main__ import main as command
from tidelog.functions import accounting, filters
from tidelog.model import Corruption, InvalidArgument, IoError, Options
from tidelog.operators.batch import WriteBatch
from tidelog.operators.repair import needs_repair, repair
from tidelog.plans import compaction
from tidelog.sources.manifest import DataFile, Manifest, Version
from tidelog.store import Store, destroy
from tidelog.streaming.ingest import ingest


def contents(store, snapshot=None):
    return {bytes(r["key"]): bytes(r["value"]) for r in store.state(snapshot).collect()}


def make(spark, path, **options):
    return Store.open(spark, path, Options(create_if_missing=True, **options))


def random_batches(seed, n, keys, size=8):
    rnd = random.Random(seed)
    for k in range(n):
        batch, ops = WriteBatch(), []
        for _ in range(rnd.randint(1, size)):
            key = b"key_%08d" % rnd.randrange(keys)
            if rnd.random() < 0.3:
                batch.delete(key)
                ops.append((key, None))
            else:
                value = b"value_%d" % rnd.randrange(10**6)
                batch.put(key, value)
                ops.append((key, value))
        yield batch, ops


def applied(state, ops):
    for key, value in ops:
        if value is None:
            state.pop(key, None)
        else:
            state[key] = value


def test_model_through_flushes_compactions_and_reopening(spark, tmp_path):
    store, state = make(spark, tmp_path / "s", auto_compaction=False), {}
    for i, (batch, ops) in enumerate(random_batches(11, 60, 80)):
        store.write(batch, sync=i % 10 == 0)
        applied(state, ops)
        if i % 20 == 9:
            store.flush()
            assert contents(store) == state
        if i == 40:
            store.compact_range()
            assert contents(store) == state
        if i == 50:
            store = store.reopened()
            assert contents(store) == state
    last = store.last_sequence
    store = store.reopened()
    assert contents(store) == state and store.last_sequence == last
    assert [bytes(r["key"]) for r in store.scan().collect()] == sorted(state)
    assert [bytes(r["key"]) for r in store.scan(reverse=True).collect()] == sorted(state, reverse=True)
    store.compact_range()
    store.vacuum()
    assert contents(store) == state
    assert store.log().count() == len(state)


def test_snapshots_survive_compaction(spark, tmp_path):
    store = make(spark, tmp_path / "s", auto_compaction=False)
    store.write_frame(spark.createDataFrame([(f"key_{i:04d}", f"a{i}") for i in range(500)], "key string, value string"))
    before = contents(store)
    snapshot = store.snapshot()
    store.write_frame(spark.createDataFrame([(f"key_{i:04d}", f"b{i}" if i % 2 else None) for i in range(500)], "key string, value string"))
    after = contents(store)
    old = store.state()
    store.compact_range()
    assert contents(store, snapshot) == before and contents(store) == after
    assert len(old.collect()) == len(after)
    store.release(snapshot)
    with pytest.raises(InvalidArgument):
        store.state(snapshot)
    store.compact_range()
    assert contents(store) == after


def test_get_and_statuses(spark, tmp_path):
    store = make(spark, tmp_path / "s")
    store.put("", "")
    store.put(b"a\x00b", b"\x00")
    store.put("gone", "x")
    store.delete("gone")
    store.delete("never")
    assert store.get("") == b"" and store.get(b"a\x00b") == b"\x00" and store.get("nope") is None
    assert store.get_status("gone")["reason"] == "deleted" and store.get_status("never")["reason"] == "deleted" and store.get_status("nope")["reason"] == "not present"
    probes = spark.createDataFrame([("",), ("gone",), ("nope",)], "key string")
    got = {bytes(r["key"]): r["status"] for r in store.multi_get(probes).collect()}
    assert got == {b"": "found", b"gone": "not_found", b"nope": "not_found"}
    assert store.multi_get(probes.limit(0)).collect() == []
    assert store.last_sequence == 5
    store.write(WriteBatch())
    assert store.last_sequence == 5
    assert bytes(store.seek("b").head()["key"]) == b"gone" if store.get("gone") else store.seek("b").head() is None
    assert bytes(store.seek_before("b").head()["key"]) == b"a\x00b"


def test_open_flags_and_lock(spark, tmp_path):
    with pytest.raises(InvalidArgument):
        Store.open(spark, tmp_path / "s")
    store = make(spark, tmp_path / "s")
    with pytest.raises(IoError):
        Store.open(spark, tmp_path / "s")
    store.close()
    with pytest.raises(InvalidArgument):
        make(spark, tmp_path / "s", error_if_exists=True)
    assert Options(write_buffer_size=1, max_file_size=1 << 40, max_open_files=1).clamped() == Options(write_buffer_size=64 << 10, max_file_size=1 << 30, max_open_files=20)


def test_prefix_after_losing_the_last_versions(spark, tmp_path):
    store, states, state = make(spark, tmp_path / "s"), [{}], {}
    for batch, ops in random_batches(5, 12, 30):
        store.write(batch)
        applied(state, ops)
        states.append(dict(state))
    store.close()
    numbers = Manifest(tmp_path / "s").numbers()
    for cut in (11, 7, 3, 0):
        for n in numbers:
            if n > cut + 1:
                Manifest(tmp_path / "s").path(n).unlink(missing_ok=True)
        store = Store.open(spark, tmp_path / "s")
        assert contents(store) == states[cut]
        store.close()


def test_torn_last_version_is_ignored_and_middle_damage_refused(spark, tmp_path):
    store = make(spark, tmp_path / "s")
    for k in range(4):
        store.put(f"k{k}", "v")
    store.close()
    manifest = Manifest(tmp_path / "s")
    last = manifest.path(manifest.numbers()[-1])
    text = last.read_text()
    for length in (0, 10, len(text) - 1):
        last.write_text(text[:length])
        with Store.open(spark, tmp_path / "s") as store:
            assert len(contents(store)) == 3
    with Store.open(spark, tmp_path / "s") as store:
        store.put("again", "v")
    with Store.open(spark, tmp_path / "s") as store:
        assert set(contents(store)) == {b"k0", b"k1", b"k2", b"again"}
    shutil.copytree(tmp_path / "s", tmp_path / "t")
    Manifest(tmp_path / "s").path(3).write_text("{")
    with pytest.raises(Corruption):
        Store.open(spark, tmp_path / "s")
    Manifest(tmp_path / "t").path(3).unlink()
    with pytest.raises(Corruption):
        Store.open(spark, tmp_path / "t")


def test_two_writers_of_one_version(tmp_path):
    manifest = Manifest(tmp_path)
    first = manifest.publish(Version(), [{"set": "last_seq", "value": 0}])
    manifest.publish(first, [{"set": "last_seq", "value": 1}])
    with pytest.raises(IoError):
        manifest.publish(first, [{"set": "last_seq", "value": 2}])
    assert manifest.load().last_seq == 1
    version = manifest.load()
    for k in range(120):
        version = manifest.publish(version, [{"set": "last_seq", "value": k}], sync=False)
    assert manifest.load().last_seq == 119 and manifest.load(60).number == 60


def test_missing_data_and_lost_manifest(spark, tmp_path):
    store = make(spark, tmp_path / "s")
    store.put("a", "1")
    store.put("b", "2")
    store.close()
    shutil.copytree(tmp_path / "s", tmp_path / "t")
    next((tmp_path / "s" / "data").glob("*.parquet")).unlink()
    with pytest.raises(Corruption):
        Store.open(spark, tmp_path / "s")
    shutil.rmtree(tmp_path / "t" / "manifest")
    with pytest.raises(Corruption):
        Store.open(spark, tmp_path / "t", Options(create_if_missing=True))
    assert needs_repair(spark, tmp_path / "t")


def test_repair(spark, tmp_path):
    store, state = make(spark, tmp_path / "s", auto_compaction=False), {}
    for i, (batch, ops) in enumerate(random_batches(3, 12, 25)):
        store.write(batch)
        applied(state, ops)
        if i == 5:
            store.flush()
    last = store.last_sequence
    store.close()
    (tmp_path / "s" / "data" / "zz.parquet").write_bytes(b"PAR1 this is no parquet PAR1")
    shutil.rmtree(tmp_path / "s" / "manifest")
    report = repair(spark, tmp_path / "s")
    assert report.files_lost == 1 and report.last_sequence == last and report.entries_kept == len(state) and report.disagreements == 0
    assert (tmp_path / "s" / "lost").is_dir()
    with Store.open(spark, tmp_path / "s") as store:
        assert contents(store) == state
        store.put("more", "x")
        assert store.get("more") == b"x"
    assert report.as_frame(spark).count() == 1


def test_repair_notes_every_disagreement_in_order(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    store = make(spark, tmp_path / "s", auto_compaction=False)
    batch = WriteBatch()
    for k in range(45):
        batch.put(f"k{k * 7 % 45:03d}", "one")
    store.write(batch)
    store.flush()
    store.close()
    for file in list((tmp_path / "s" / "data").rglob("*.parquet")):
        table = pq.read_table(file)
        at = table.schema.get_field_index("value")
        other = table.set_column(at, table.schema.field(at), pa.array([b"two"] * len(table), table.schema.field(at).type))
        pq.write_table(other, file.with_name(f"zz-{file.name}"), write_page_checksum=True)
    shutil.rmtree(tmp_path / "s" / "manifest")
    report = repair(spark, tmp_path / "s")
    assert report.disagreements == 45 and report.entries_kept == 45 and report.files_lost == 0
    assert [n.split(" ")[0] for n in report.notes] == [repr(f"k{k:03d}".encode()) for k in range(45)]


def test_page_damage_is_an_error(spark, tmp_path):
    store = make(spark, tmp_path / "s", compression="none")
    store.put("key", "x" * 5000)
    file = next((tmp_path / "s" / "data").glob("*.parquet"))
    data = bytearray(file.read_bytes())
    data[data.index(b"xxxxxxxxxx") + 100] ^= 1
    file.write_bytes(bytes(data))
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        store.state().collect()
    store.close()


def test_properties_and_counters(spark, tmp_path):
    store = make(spark, tmp_path / "s", auto_compaction=False)
    handed = 0
    for k in range(5):
        store.put(f"key{k}", "v" * k)
        handed += 4 + k
    assert store.property("tidelog.last-sequence") == "5"
    assert store.property("tidelog.num-files-at-level0") == "0" and store.property("tidelog.num-files-at-level7") is None
    assert store.property("tidelog.num-files-at-levelx") is None and store.property("last-sequence") is None
    assert store.property("tidelog.log-writes") == "records 5\nbatches 5"
    logs = sum(p.stat().st_size for p in (store.root / "data").glob("*-log.parquet"))
    assert store.bytes_written()["log"] == logs and store.bytes_handed_in() == handed
    assert int(store.property("tidelog.approximate-memory-usage")) == logs
    store.flush()
    assert store.property("tidelog.approximate-memory-usage") == "0"
    assert sum(int(store.property(f"tidelog.num-files-at-level{n}")) for n in range(7)) == 1
    assert "key0" in store.property("tidelog.sstables") and store.property("tidelog.stats").startswith("level")
    assert store.files().count() == 1
    assert store.bytes_written()["flush"] == store.files().agg({"bytes": "sum"}).head()[0]
    assert accounting.amplification({"log": 10, "flush": 20}, 10, 5) == {"write_log": 1.0, "write_flush": 2.0, "write": 3.0, "space": 0.5}
    assert store.approximate_offset("zzz") > 0 and store.approximate_offset("a") == 0


def test_destroy_leaves_foreign_files(spark, tmp_path):
    store = make(spark, tmp_path / "s")
    store.put("a", "b")
    store.close()
    (tmp_path / "s" / "mine.txt").write_text("x")
    destroy(tmp_path / "s")
    assert [p.name for p in (tmp_path / "s").iterdir()] == ["mine.txt"]


def test_stream_replays_change_nothing(spark, tmp_path):
    rows = [(i % 40, i, 0 if i % 7 == 0 else 1, None if i % 7 == 0 else f"v{i}") for i in range(300)]
    frame = spark.createDataFrame(rows, "k long, seq long, op int, value string").selectExpr("concat('k', k) AS key", "seq", "op", "value")
    for part in range(3):
        frame.where(f"seq >= {part * 100} AND seq < {part * 100 + 100}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = make(spark, tmp_path / "s")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest(stream, store, str(tmp_path / "c1"), "x", order="seq").awaitTermination()
    want = {}
    applied(want, [(f"k{k}".encode(), v and v.encode()) for k, _, _, v in rows])
    assert contents(store) == want
    last = store.last_sequence
    ingest(stream, store, str(tmp_path / "c2"), "x", order="seq").awaitTermination()
    assert store.last_sequence == last and contents(store) == want


def frame(spark, rows, parts=1):
    """A DataFrame of (key, value) rows; ``parts`` may list the rows of each partition."""
    schema = "key string, value string"
    if parts == 1:
        return spark.createDataFrame(rows, schema).coalesce(1)
    out, at = None, 0
    for n in parts:
        piece = spark.createDataFrame(rows[at : at + n], schema).coalesce(1)
        out, at = piece if out is None else out.union(piece), at + n
    return out


def test_deletes_hold_against_older_logs(spark, tmp_path):
    store = make(spark, tmp_path / "s", auto_compaction=False)
    store.put("k", "v1")
    store.write_frame(frame(spark, [("a", "1"), ("k", None), ("z", "1")]))
    for i in range(4):
        store.write_frame(frame(spark, [("a", str(i)), ("z", str(i))]))
    assert store.compact_once() and store.get("k") is None
    while store.compact_once():
        pass
    store.compact_range()
    assert contents(store) == {b"a": b"3", b"z": b"3"}
    assert contents(store.reopened()) == {b"a": b"3", b"z": b"3"}


def test_base_level_asks_logs_and_the_range():
    log = DataFile(7, 0, "f7", 1, 1, b"k", b"k", 1, 1, "log")
    deep = [_file(1, 3, b"a", b"c"), _file(2, 3, b"d", b"f"), _file(3, 4, b"c", b"d")]
    assert compaction.is_base_level(Version(1, {f.file_no: f for f in deep}), 0, b"g", b"z") is True
    assert compaction.is_base_level(Version(1, {f.file_no: f for f in [*deep, log]}), 0, b"g", b"z") is not True
    assert compaction.is_base_level(Version(1, {f.file_no: f for f in deep}), 3, b"a", b"z") is True


def test_frames_keep_their_order(spark, tmp_path):
    store = make(spark, tmp_path / "s", auto_compaction=False)
    big = [(f"key{i:06d}", "x" * 40) for i in range(60000)]
    rows = [("k", "old"), *big[:3], *big, ("k", "newer"), ("k", "new")]
    store.write_frame(frame(spark, rows, parts=[1, 3, len(big), 1, 1]))
    assert store.get("k") == b"new" and store.last_sequence == len(rows)
    seqs = [r["seq"] for r in store.log().where("key = CAST('k' AS BINARY)").orderBy("seq").collect()]
    assert seqs == [1, len(rows) - 1, len(rows)]
    assert store.bytes_written()["log"] > 0


def test_random_mix_of_writes_and_compactions(spark, tmp_path):
    rnd, model = random.Random(5), {}
    store = make(spark, tmp_path / "s", auto_compaction=False, write_buffer_size=1)
    for step in range(24):
        what = rnd.random()
        rows = [(f"k{rnd.randrange(12)}", None if rnd.random() < 0.4 else f"v{step}-{i}") for i in range(rnd.randint(1, 4))]
        if what < 0.45:
            for k, v in rows:
                store.put(k, v) if v is not None else store.delete(k)
        elif what < 0.85:
            store.write_frame(frame(spark, rows))
        else:
            store.compact_once()
            rows = []
        applied(model, [(k.encode(), v and v.encode()) for k, v in rows])
        if step % 4 == 3:
            assert contents(store) == model, step
    store.compact_range()
    assert contents(store) == model


def test_queued_writers_commit_in_groups(spark, tmp_path):
    store = make(spark, tmp_path / "s")
    writers = [(WriteBatch().put(f"k{i}", "v").delete("gone"), i == 3) for i in range(5)]
    assert store.write_queue(writers) == [2, 4, 6, 8, 10]
    assert store.property("tidelog.log-writes") == "records 10\nbatches 2" and len(contents(store)) == 5


def test_malformed_rows_are_refused_when_read(spark, tmp_path):
    store = make(spark, tmp_path / "s")
    store.put("a", "1")
    path = next((tmp_path / "s" / "data").glob("*.parquet"))
    table = pq.read_table(path)
    pq.write_table(table.set_column(table.schema.get_field_index("op"), "op", pa.array([7], pa.int8())), path, write_page_checksum=True)
    path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="malformed log row at seq 1"):
        store.state().collect()
    store.close()


def test_repair_command(spark, tmp_path, capsys):
    store = make(spark, tmp_path / "s")
    store.put("a", "1")
    store.close()
    assert command(["repair"]) == 2 and command(["mend", "x"]) == 2
    assert command(["repair", str(tmp_path / "s")]) == 3
    assert command(["repair", str(tmp_path / "s"), "--force"]) == 0
    assert command(["repair", str(tmp_path / "none")]) == 1
    assert contents(Store.open(spark, tmp_path / "s")) == {b"a": b"1"}


def test_repair_sets_aside_gapped_and_unordered_files(spark, tmp_path):
    store = make(spark, tmp_path / "s")
    for k in "abc":
        store.write(WriteBatch().put(k, "1").put(k + "x", "2"))
    store.close()
    first, second, _ = sorted((tmp_path / "s" / "data").glob("*.parquet"))
    table = pq.read_table(first)
    pq.write_table(table.set_column(table.schema.get_field_index("seq"), "seq", pa.array([1, 9], pa.int64())), first)
    pq.write_table(pq.read_table(second).take([1, 0]), second)
    for p in (first, second):
        p.with_name(f".{p.name}.crc").unlink(missing_ok=True)
    report = repair(spark, tmp_path / "s")
    assert (report.files_found, report.files_used, report.files_lost, report.entries_kept) == (3, 1, 2, 2)
    assert any("sequence numbers" in n for n in report.notes) and any("out of order" in n for n in report.notes)


def test_failed_write_makes_the_store_read_only(spark, tmp_path, monkeypatch):
    store = make(spark, tmp_path / "s")
    store.put("a", "1")

    def fail(*_, **__):
        raise IoError("disk full")

    monkeypatch.setattr(Manifest, "publish", fail)
    with pytest.raises(IoError):
        store.put("b", "2")
    monkeypatch.undo()
    with pytest.raises(IoError):
        store.put("c", "3")
    assert contents(store) == {b"a": b"1"}
    store = store.reopened()
    store.put("d", "4")
    assert contents(store) == {b"a": b"1", b"d": b"4"}


def _file(no, level, a, z, size=1 << 20):
    return DataFile(no, level, f"f{no}", size, 10, a, z, 1, 10)


def test_picking():
    options = Options().clamped()
    version = Version(1, {f.file_no: f for f in [_file(k, 0, b"a%d" % k, b"m%d" % k) for k in range(4)] + [_file(9, 1, b"b", b"c"), _file(10, 1, b"x", b"z")]})
    job = compaction.pick(version, options)
    assert job.level == 0 and len(job.inputs) == 4 and [f.file_no for f in job.below] == [9] and not job.is_move(options)
    assert dict(compaction.scores(version, options))[0] == 1.0
    lone = Version(1, {1: _file(1, 1, b"a", b"b", 11 << 20), 2: _file(2, 3, b"x", b"z")})
    job = compaction.pick(lone, options)
    assert job.level == 1 and job.is_move(options)
    assert compaction.pick(Version(1, {1: _file(1, 0, b"a", b"b")}), options) is None
    assert compaction.flush_level(Version(), b"a", b"b", options) == 2
    assert compaction.flush_level(Version(1, {1: _file(1, 1, b"a", b"b")}), b"b", b"c", options) == 0
    meeting = [_file(1, 1, b"a", b"k"), _file(2, 1, b"k", b"p"), _file(3, 1, b"q", b"r")]
    assert [f.file_no for f in compaction.with_boundaries(meeting, meeting[:1])] == [1, 2]
    chained = Version(1, {f.file_no: f for f in [_file(1, 0, b"a", b"c"), _file(2, 0, b"b", b"f"), _file(3, 0, b"e", b"h"), _file(4, 0, b"x", b"y")]})
    assert {f.file_no for f in chained.overlapping(0, b"a", b"a")} == {1, 2, 3}


def test_bloom_policy():
    policy = filters.BloomPolicy(10)
    keys = [b"key_%010d" % k for k in range(5000)]
    made = policy.create(keys)
    assert all(policy.may_match(k, made) for k in keys)
    assert sum(policy.may_match(k + b"-", made) for k in keys) < 0.02 * len(keys)
    assert not policy.may_match(b"x", b"")


def test_percentiles(spark):
    values = spark.createDataFrame([(float(v),) for v in [5, 1, 3, 3, 9, 7, 7, 7, 2, 8]], "v double")
    got = {r["quantile"]: r["value"] for r in accounting.rank_percentile(values, "v", [0.0, 0.5, 0.9, 1.0]).collect()}
    ordered = sorted([5, 1, 3, 3, 9, 7, 7, 7, 2, 8])
    assert got == {q: float(ordered[int(q * 9)]) for q in (0.0, 0.5, 0.9, 1.0)}
