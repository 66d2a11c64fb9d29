"""Registered queries that answer over every event, against brute force."""

import datetime
import json

import pytest

from tidelog import queries as base
from tidelog import stored_queries
from tidelog.functions import filters
from tidelog.operators import batch as B

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """4,003 events; now and then one of a long text, so that groups end at odd places."""
    root = tmp_path_factory.mktemp("sf")
    rows = [(i, datetime.datetime(2024, 1, 1), i * 7 % 311, "error" if i % 11 == 3 else "view", 1.0, "é" * (i * 37 % 900) + "x" * (150_000 if i % 1009 == 5 else 0)) for i in range(4003)]
    spark.createDataFrame(rows, EVENTS).repartition(5).write.parquet(str(root / "events.parquet"))
    return str(root)


def test_group_commit_groups_every_event(spark, events):
    rows = base.mutations(spark, events).orderBy("seq").collect()
    writers = []
    for k in range(0, len(rows), 10):
        batch = B.WriteBatch()
        for r in rows[k : k + 10]:
            batch.put(r["key"], r["value"]) if r["op"] else batch.delete(r["key"])
        writers.append((batch, k % 70 == 0))
    want = [(i, len(bs), sum(map(len, bs)), s) for i, (bs, s) in enumerate(B.group(writers))]
    got = stored_queries.QUERIES["group_commit"](spark, events).orderBy("number").collect()
    assert [tuple(r) for r in got] == want and sum(r["operations"] for r in got) == 4003


def test_bloom_probes_every_key(spark, tmp_path):
    many = 100_700
    stamp = datetime.datetime(2024, 1, 1)
    spark.range(many + 300).selectExpr("id AS event_id", f"TIMESTAMP'{stamp}' AS ts", f"id % {many} AS user_id", "'view' AS event_type", "1D AS value", "'p' AS props").write.parquet(str(tmp_path / "events.parquet"))
    r = stored_queries.QUERIES["bloom_false_positives"](spark, str(tmp_path)).head()
    shape = json.loads(r["filter"])
    assert r["keys"] == many and r["missed"] == 0 and 0 < r["passed"] < 0.02 * many
    assert 10 * many <= shape["bits"] < 10 * many + 200 and shape["probes"] == 7


def test_bloom_of_few_keys_is_one_filter(spark, events):
    keys = sorted(r["key"].encode() for r in base.mutations(spark, events).select("key").distinct().collect())
    policy = filters.BloomPolicy(10)
    made = policy.create(keys)
    want = (len(keys), 0, sum(policy.may_match(k + b"-", made) for k in keys), json.dumps({"bits": 8 * len(made), "probes": policy.probes}))
    assert [tuple(r) for r in stored_queries.QUERIES["bloom_false_positives"](spark, events).collect()] == [want]
