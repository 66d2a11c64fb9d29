"""The registered queries of the key/value operators, each with the SQL that gives the same rows.

They run on a mutation log made of ``events``: the key is the user, the clock the event's number, an ``error`` event
deletes, other events put their ``props``. Keys are text here; they are ASCII, so text and byte order agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import accounting
from .model import DELETE, LEVELS, PUT
from .operators import mvcc

EARLY, LATE = 5000, 7000
RUN_SEQS = 2500
TARGET = "user_00000042"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, seq, op, value, batch_id) of the events; ten events are a batch."""
    error = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user_"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("key"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(error, DELETE).otherwise(PUT).alias("op"),
        F.when(~error, F.col("props")).alias("value"),
        F.floor(F.col("event_id") / 10).cast("long").alias("batch_id"),
    )


_BASE = """WITH m AS (SELECT 'user_' || LPAD(CAST(user_id AS VARCHAR), 8, '0') AS k, event_id + 1 AS seq,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op,
  CASE WHEN event_type = 'error' THEN NULL ELSE props END AS v,
  CAST((event_id - event_id % 10) / 10 AS BIGINT) AS batch_id FROM events)"""


def _newest(name: str, snapshot: int | None = None) -> str:
    bound = "" if snapshot is None else f" WHERE seq <= {snapshot}"
    return f""", {name} AS (SELECT k, v, op, seq FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY seq DESC, op DESC) AS rn FROM m{bound}) t WHERE rn = 1)"""


def _runs(log: DataFrame) -> DataFrame:
    """Statistics of the runs that flushing every RUN_SEQS entries makes; the older half lies in level 1."""
    numbered = log.withColumn("file_no", F.floor((F.col("seq") - 1) / RUN_SEQS).cast("long"))
    size = F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).alias("bytes")
    runs = numbered.groupBy("file_no").agg(F.count("*").alias("entries"), F.min("key").alias("smallest"), F.max("key").alias("largest"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), size)
    return runs.withColumn("level", F.when(F.col("file_no") < 2, 1).otherwise(0).cast("long"))


_RUNS = f""", runs AS (SELECT CAST((seq - 1 - (seq - 1) % {RUN_SEQS}) / {RUN_SEQS} AS BIGINT) AS file_no, COUNT(*) AS entries, MIN(k) AS smallest, MAX(k) AS largest,
  MIN(seq) AS min_seq, MAX(seq) AS max_seq, CAST(SUM(STRLEN(k) + COALESCE(STRLEN(v), 0)) AS BIGINT) AS bytes,
  CAST(CASE WHEN (seq - 1 - (seq - 1) % {RUN_SEQS}) / {RUN_SEQS} < 2 THEN 1 ELSE 0 END AS BIGINT) AS level FROM m GROUP BY 1, 8)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(_BASE + _newest("n") + " SELECT k AS key, v AS value FROM n WHERE op = 1")
def latest_state(spark, sf_dir):
    return mvcc.visible(mutations(spark, sf_dir)).select("key", "value")


@query(_BASE + _newest("n", EARLY) + " SELECT k AS key, v AS value FROM n WHERE op = 1")
def as_of_snapshot(spark, sf_dir):
    return mvcc.visible(mutations(spark, sf_dir), EARLY).select("key", "value")


@query(_BASE + _newest("n") + " SELECT k AS key, v AS value FROM n WHERE op = 1")
def forward_scan(spark, sf_dir):
    return mvcc.scan(mutations(spark, sf_dir))


@query(_BASE + _newest("n") + " SELECT k AS key, v AS value FROM n WHERE op = 1 ORDER BY k DESC")
def reverse_scan(spark, sf_dir):
    return mvcc.scan(mutations(spark, sf_dir), reverse=True)


@query(_BASE + _newest("n", LATE) + " SELECT k AS key, v AS value FROM n WHERE op = 1 AND k >= 'user_00000020' AND k < 'user_00000090'")
def range_scan(spark, sf_dir):
    return mvcc.scan(mutations(spark, sf_dir), LATE, "user_00000020", "user_00000090")


@query(_BASE + _newest("n") + f" SELECT k AS key, v AS value FROM n WHERE op = 1 AND k >= '{TARGET}-' ORDER BY k LIMIT 5")
def seek_limit(spark, sf_dir):
    return mvcc.seek(mutations(spark, sf_dir), f"{TARGET}-", 5)


@query(_BASE + _newest("n") + f" SELECT MAX(k) AS key FROM n WHERE op = 1 AND k < '{TARGET}'")
def prev_key(spark, sf_dir):
    return mvcc.seek_before(mutations(spark, sf_dir), TARGET).select("key")


@query(_BASE + _newest("n") + " SELECT k AS key, LAG(k) OVER (ORDER BY k) AS previous, LEAD(k) OVER (ORDER BY k) AS next FROM n WHERE op = 1")
def neighbours(spark, sf_dir):
    return mvcc.neighbours(mvcc.visible(mutations(spark, sf_dir)))


@query(_BASE + _newest("n") + """, probes AS (SELECT DISTINCT k FROM m UNION SELECT DISTINCT k || '-' FROM m)
 SELECT p.k AS key, CASE WHEN op = 1 THEN 'found' ELSE 'not_found' END AS status,
  CASE WHEN op IS NULL THEN 'not present' WHEN op = 0 THEN 'deleted' END AS reason, v AS value FROM probes p LEFT JOIN n ON p.k = n.k""")
def multi_get_status(spark, sf_dir):
    log = mutations(spark, sf_dir)
    probes = log.select("key").distinct()
    return mvcc.lookup(log, probes.union(probes.select(F.concat("key", F.lit("-")))))


@query(_BASE + _newest("n") + f" SELECT k AS key, CASE WHEN op = 1 THEN 'found' ELSE 'not_found' END AS status, CASE WHEN op = 0 THEN 'deleted' END AS reason, v AS value FROM n WHERE k = '{TARGET}'")
def point_get(spark, sf_dir):
    log = mutations(spark, sf_dir)
    return mvcc.lookup(log.where(F.col("key") == TARGET), spark.createDataFrame([(TARGET,)], "key string"))


@query(_BASE + _newest("n") + " SELECT k AS key, seq FROM n WHERE op = 0")
def tombstones(spark, sf_dir):
    return mvcc.tombstones(mutations(spark, sf_dir))


@query(_BASE + f""", w AS (SELECT *, LAG(seq) OVER (PARTITION BY k ORDER BY seq DESC) AS newer FROM m)
 SELECT k AS key, seq, CAST(op AS INTEGER) AS op, v AS value FROM w WHERE NOT COALESCE(newer <= {LATE}, FALSE) AND NOT (op = 0 AND seq <= {LATE})""")
def compaction_retention(spark, sf_dir):
    return mvcc.retained(mutations(spark, sf_dir), LATE).select("key", "seq", F.col("op").cast("int").alias("op"), "value")


@query(_BASE + f""", w AS (SELECT *, LAG(seq) OVER (PARTITION BY k ORDER BY seq DESC) AS newer FROM m)
 SELECT k AS key, seq, CAST(op AS INTEGER) AS op, v AS value FROM w WHERE NOT COALESCE(newer <= {LATE}, FALSE) AND NOT (op = 0 AND seq <= {LATE} AND NOT (k BETWEEN 'user_00000030' AND 'user_00000060'))""")
def compaction_retention_deeper(spark, sf_dir):
    covered = F.col("key").between("user_00000030", "user_00000060")
    return mvcc.retained(mutations(spark, sf_dir), LATE, ~covered).select("key", "seq", F.col("op").cast("int").alias("op"), "value")


@query(_BASE + """, f AS (SELECT *, 1 AS file_no FROM m WHERE seq <= 6000 UNION ALL SELECT *, 2 AS file_no FROM m WHERE seq > 4000),
 r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY seq DESC, op DESC, file_no) AS rn FROM f)
 SELECT k AS key, seq, v AS value FROM r WHERE rn = 1 AND op = 1""")
def repair_merge(spark, sf_dir):
    log = mutations(spark, sf_dir)
    files = log.where("seq <= 6000").withColumn("file_no", F.lit(1)).unionByName(log.where("seq > 4000").withColumn("file_no", F.lit(2)))
    return mvcc.repaired(files).select("key", "seq", "value")


@query(_BASE + " SELECT k AS key, seq, CAST(op AS INTEGER) AS op, v AS value FROM m")
def merge_runs(spark, sf_dir):
    log = mutations(spark, sf_dir)
    runs = [log.where((F.col("seq") % 3) == k) for k in range(3)]
    return mvcc.merge_runs(*runs).select("key", "seq", F.col("op").cast("int").alias("op"), "value")


@query(_BASE + _newest("a", EARLY) + _newest("b", LATE) + """, x AS (SELECT k, v FROM a WHERE op = 1), y AS (SELECT k, v FROM b WHERE op = 1)
 SELECT COALESCE(x.k, y.k) AS key, CASE WHEN x.k IS NULL THEN 'added' WHEN y.k IS NULL THEN 'removed' ELSE 'changed' END AS change, x.v AS old, y.v AS new
 FROM x FULL JOIN y ON x.k = y.k WHERE x.k IS NULL OR y.k IS NULL OR x.v IS DISTINCT FROM y.v""")
def snapshot_diff(spark, sf_dir):
    return mvcc.diff(mutations(spark, sf_dir), EARLY, LATE)


@query(_BASE + " SELECT CAST(SUM(STRLEN(k) + COALESCE(STRLEN(v), 0)) AS BIGINT) AS bytes FROM m")
def bytes_handed_in(spark, sf_dir):
    return mutations(spark, sf_dir).agg(accounting.bytes_handed_in().alias("bytes"))


@query(_BASE + " SELECT batch_id, COUNT(*) AS entries, MIN(seq) AS first_seq, MAX(seq) AS last_seq, MAX(seq) - MIN(seq) + 1 = COUNT(*) AS dense FROM m GROUP BY batch_id")
def batch_validation(spark, sf_dir):
    return mvcc.batches(mutations(spark, sf_dir))


@query(_BASE + """, kept AS (SELECT * FROM m WHERE NOT (seq % 1000 = 778 AND batch_id > 100)),
 broken AS (SELECT MIN(b.batch_id) AS broken FROM (SELECT batch_id, COUNT(*) AS n FROM m GROUP BY 1) b LEFT JOIN (SELECT batch_id, COUNT(*) AS n FROM kept GROUP BY 1) g ON b.batch_id = g.batch_id WHERE b.n IS DISTINCT FROM COALESCE(g.n, 0))
 SELECT k AS key, seq, CAST(op AS INTEGER) AS op, v AS value FROM kept, broken WHERE broken IS NULL OR batch_id < broken""")
def prefix_recovery(spark, sf_dir):
    log = mutations(spark, sf_dir)
    declared = log.groupBy("batch_id").agg(F.count("*").alias("entries"))
    damaged = log.where(~((F.col("seq") % 1000 == 778) & (F.col("batch_id") > 100)))
    return mvcc.intact_prefix(damaged, declared).select("key", "seq", F.col("op").cast("int").alias("op"), "value")


@query(_BASE + _RUNS + " SELECT file_no, entries, smallest, largest, min_seq, max_seq, bytes, level FROM runs")
def flush_runs(spark, sf_dir):
    return _runs(mutations(spark, sf_dir))


@query(_BASE + _RUNS + " SELECT level, COUNT(*) AS files, CAST(SUM(bytes) AS BIGINT) AS bytes, CAST(SUM(entries) AS BIGINT) AS entries FROM runs GROUP BY level")
def level_stats(spark, sf_dir):
    return _runs(mutations(spark, sf_dir)).groupBy("level").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("entries").alias("entries"))


@query(_BASE + _RUNS + f" SELECT r.level, COUNT(file_no) AS files FROM (SELECT UNNEST(RANGE(0, {LEVELS})) AS level) r LEFT JOIN runs ON r.level = runs.level GROUP BY r.level")
def num_files_at_level(spark, sf_dir):
    return spark.range(LEVELS).withColumnRenamed("id", "level").join(_runs(mutations(spark, sf_dir)), "level", "left").groupBy("level").agg(F.count("file_no").alias("files"))


@query(_BASE + _RUNS + """, s AS (SELECT level, CASE WHEN level = 0 THEN COUNT(*) / 4.0 ELSE SUM(bytes) / 10485760.0 END AS score FROM runs GROUP BY level)
 SELECT level, CAST(FLOOR(score * 1000) AS BIGINT) AS milli_score, score = (SELECT MAX(score) FROM s) AS picked FROM s""")
def level_scores(spark, sf_dir):
    sums = _runs(mutations(spark, sf_dir)).groupBy("level").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    score = F.when(F.col("level") == 0, F.col("files") / 4.0).otherwise(F.col("bytes") / 10485760.0)
    scored = sums.select("level", score.alias("score"))
    # Levels are seven at most.
    return scored.join(F.broadcast(scored.agg(F.max("score").alias("top"))), how="cross").select("level", F.floor(F.col("score") * 1000).cast("long").alias("milli_score"), (F.col("score") == F.col("top")).alias("picked"))


@query(_BASE + _RUNS + f" SELECT file_no, level FROM runs WHERE smallest <= '{TARGET}' AND largest >= '{TARGET}'")
def files_covering_key(spark, sf_dir):
    return _runs(mutations(spark, sf_dir)).where((F.col("smallest") <= TARGET) & (F.col("largest") >= TARGET)).select("file_no", "level")


@query(_BASE + _RUNS + " SELECT file_no, bytes FROM runs WHERE level = 1 AND largest >= 'user_00000010' AND smallest <= 'user_00000020'")
def overlapping_inputs(spark, sf_dir):
    return _runs(mutations(spark, sf_dir)).where("level = 1 AND largest >= 'user_00000010' AND smallest <= 'user_00000020'").select("file_no", "bytes")


@query(_BASE + _RUNS + " SELECT a.file_no FROM runs a WHERE a.level = 1 AND NOT EXISTS (SELECT 1 FROM runs b WHERE b.level = 2 AND b.largest >= a.smallest AND b.smallest <= a.largest)")
def trivial_move_candidates(spark, sf_dir):
    runs = _runs(mutations(spark, sf_dir))
    a, b = runs.where("level = 1").alias("a"), runs.where("level = 2").alias("b")
    # The files of two levels; the manifest bounds both.
    return a.join(F.broadcast(b), F.expr("b.largest >= a.smallest AND b.smallest <= a.largest"), "left_anti").select("file_no")


@query(_BASE + f" SELECT MAX(seq) AS last_sequence, COUNT(*) AS entries, COUNT(DISTINCT k) AS keys, CAST(SUM(CASE WHEN seq <= {EARLY} THEN 1 ELSE 0 END) AS BIGINT) AS at_snapshot FROM m")
def last_sequence(spark, sf_dir):
    return mutations(spark, sf_dir).agg(F.max("seq").alias("last_sequence"), F.count("*").alias("entries"), F.countDistinct("key").alias("keys"), F.sum((F.col("seq") <= EARLY).cast("long")).alias("at_snapshot"))


@query("SELECT o_custkey AS key, MAX(o_orderkey) AS seq, ARG_MAX(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY o_custkey")
def latest_order_per_customer(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.lit(PUT).alias("op"), F.col("o_orderstatus").alias("value"))
    return mvcc.visible(log)


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey AS seq, o_orderstatus AS v, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)
 SELECT c_custkey AS key, CASE WHEN rn = 1 AND v <> 'F' THEN 'found' ELSE 'not_found' END AS status, CASE WHEN rn IS NULL THEN 'not present' WHEN v = 'F' THEN 'deleted' END AS reason, CASE WHEN v <> 'F' THEN v END AS value
 FROM customer LEFT JOIN o ON c_custkey = k AND rn = 1""")
def customer_multi_get(spark, sf_dir):
    finished = F.col("o_orderstatus") == "F"
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.when(finished, DELETE).otherwise(PUT).alias("op"), F.when(~finished, F.col("o_orderstatus")).alias("value"))
    return mvcc.lookup(log, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")))


@query("""WITH s AS (SELECT l_quantity AS v, ROW_NUMBER() OVER (ORDER BY l_quantity) - 1 AS place, COUNT(*) OVER () AS n FROM lineitem)
 SELECT q AS quantile, MIN(v) AS value FROM s, (SELECT UNNEST([0.5::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE, 0.999::DOUBLE]) AS q) WHERE place = FLOOR(q * (n - 1)) GROUP BY q""")
def latency_percentiles(spark, sf_dir):
    return accounting.rank_percentile(table(spark, sf_dir, "lineitem"), "l_quantity", [0.5, 0.9, 0.99, 0.999])
