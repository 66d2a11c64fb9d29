"""Physical plans: what reaches the scan, and how often rows are shuffled."""

import re

from tidelog import queries
from tidelog.model import Options
from tidelog.operators import mvcc
from tidelog.store import Store


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (hash|range|Single)", plan_of(df)))


def test_range_and_snapshot_reach_the_scan(spark, tmp_path):
    with Store.open(spark, tmp_path / "s", Options(create_if_missing=True)) as store:
        store.write_frame(spark.createDataFrame([(f"k{i:03d}", "v") for i in range(100)], "key string, value string"))
        snapshot = store.snapshot()
        store.write_frame(spark.createDataFrame([("k500", "v")], "key string, value string"))
        plan = plan_of(store.state(snapshot, "k010", "k020"))
        pushed = re.search(r"PushedFilters: \[([^\]]*)", plan)[1]
        assert "GreaterThanOrEqual(key" in pushed and "LessThanOrEqual(seq" in pushed
        assert "batch_id" not in re.search(r"ReadSchema: (\S+)", plan)[1]
        before = store.property("tidelog.table-reads")
        store.state(begin="x").collect()
        assert store.property("tidelog.table-reads") == before  # no file reaches so far
        assert shuffles(store.state()) == 1 and shuffles(store.scan()) == 2


def test_one_shuffle_each(spark, tmp_path):
    rows = [(f"k{i % 7}", i, i % 3 and 1, "v" if i % 3 else None) for i in range(50)]
    spark.createDataFrame(rows, "key string, seq long, op int, value string").write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    for df in (mvcc.visible(log), mvcc.tombstones(log, 20), mvcc.diff(log, 10, 30), mvcc.retained(log, 25)):
        assert shuffles(df) == 1
    assert "TakeOrderedAndProject" in plan_of(mvcc.seek(log, "k3", 2)) and shuffles(mvcc.seek(log, "k3", 2)) == 1


def test_queries_have_sql_but_for_reports():
    assert set(queries.QUERIES) == set(queries.ORACLES)
