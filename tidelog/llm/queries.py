"""The registered queries of the text operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, dac, decontam, license, minhash, multiset, quality, suffix, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, added_tokens=True)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return license.scan_licenses(table(spark, sf_dir, "documents")).select(*columns)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(table(spark, sf_dir, "documents"))


def op6_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


QUERIES = {f.__name__: f for f in (op1_token_ids, op2_near_duplicates, op3_fingerprints, op4_license_scan, op5_suffix_dedup, op6_warc_bundles, op7_quality, op8_toxicity, op9_decontamination, op10_byte_bpe)}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_NEAR = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM k JOIN c ca ON ca.doc_id = x JOIN c cb ON cb.doc_id = y WHERE 100 * k >= 80 * (ca.n + cb.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS t FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.t = e.x)
SELECT r.doc_id, coalesce(max(c.n), 0) AS n_shingles, min(t) AS component_id, r.doc_id = min(t) AS kept FROM r LEFT JOIN c ON c.doc_id = r.doc_id GROUP BY r.doc_id"""

_ARCHIVES = """WITH q AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS x, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS o FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST((((strpos('0123456789abcdef', substr(x, CAST(5 * g // 4 + 1 AS BIGINT), 1)) - 1) * 16 + strpos('0123456789abcdef', substr(x, CAST(5 * g // 4 + 2 AS BIGINT), 1)) - 1) // CAST(pow(2, 3 - (5 * g) % 4) AS BIGINT)) % 32 + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN o = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN o <> page_id THEN o END AS refers_to, TRUE AS digest_ok FROM q"""

_REPEATS = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, b, unnest(range(1, n - 398)) AS p FROM d WHERE n >= 400),
h AS (SELECT doc_id, p, md5(b[p:p + 399]) AS x FROM w),
r AS (SELECT doc_id, p FROM h QUALIFY count(*) OVER (PARTITION BY x) > 1),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 400 THEN 0 ELSE 1 END AS s FROM r),
k AS (SELECT doc_id, p, sum(s) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM g),
z AS (SELECT doc_id, s, min(p) AS a, max(p) + 400 AS e FROM k GROUP BY doc_id, s),
q AS (SELECT doc_id, a, e, lag(e, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS f FROM z UNION ALL SELECT d.doc_id, n + 1, n + 1, coalesce((SELECT max(e) FROM z WHERE z.doc_id = d.doc_id), 1) FROM d),
t AS (SELECT q.doc_id, string_agg(hex(b[f:a - 1]), '' ORDER BY a) AS kept, CAST(sum(e - a) AS BIGINT) AS gone, count(*) - 1 AS spans FROM q JOIN d ON d.doc_id = q.doc_id GROUP BY q.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, gone AS n_removed, spans AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM t JOIN d ON d.doc_id = t.doc_id"""

_LEAKS = rf"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
v AS (SELECT item, w, least(len(w), 13) AS l, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM v),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
u AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l),
h AS (SELECT doc_id, u.i, u.l, item FROM u JOIN win ON win.l = u.l AND win.g = array_to_string(w[u.i:u.i + u.l - 1], ' ')),
x AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(x.n, 0) AS n_hit, coalesce(y.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(x.n, 0) > 0 AND 20 * coalesce(x.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN x ON d.doc_id = x.doc_id LEFT JOIN y ON d.doc_id = y.doc_id"""

#: The other operators' rows hang on a tokenizer, a trained model, own hashes or templates; tests hold them against brute force.
ORACLES: dict[str, str] = {"op2_near_duplicates": _NEAR, "op5_suffix_dedup": _REPEATS, "op6_warc_bundles": _ARCHIVES, "op9_decontamination": _LEAKS}
