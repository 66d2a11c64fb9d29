"""Document fingerprints: a homomorphic hash of the multiset of paragraphs, in DataFrame functions only.

A paragraph (the text between line ends) is hashed to a wide vector and a document's fingerprint is the sum of
the vectors, each lane modulo a power of two. So the order of paragraphs does not matter, and adding or taking
away a paragraph adds or subtracts its vector (:func:`insert`, :func:`delete`).

The vector has three parts:
    WIDE lanes modulo 2**32, each a hash of the whole paragraph under its own seed: they decide equality;
    the number of the paragraph's phrases;
    64 lanes modulo 2**32, two in a number: how many of its phrases have a 1 at this bit of their hash.
A phrase ends after white space that follows one of a fixed set of characters, which about a third of words end
with, so an edit disturbs few phrases. With ones o of n phrases, 2 * o - n is a random projection of the multiset
of phrases, and the cosine of two documents' projections estimates that of their phrases: :func:`likeness`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runtime

WIDE = 16
PAIRS = 32
MASK = (1 << 32) - 1
#: Both lanes of a number.
LANES = (1 << 32) + 1
PHRASE_END = r"(?<=[dnst,.;:!?|*$&%#DNST])\s+"

#: A text's phrases over all its paragraphs are those of its paragraphs: a line end after another character ends one too.
_SPLIT = rf"\n|{PHRASE_END}"


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of the column ``text`` (no null) as an array of longs."""
    paragraphs, phrases = f"__{name}_paragraphs", f"__{name}_phrases"
    columns = df.columns
    # Arrays that lambdas read are columns of their own, so they are made once a row.
    df = df.withColumn(paragraphs, F.split(text, "\n")).withColumn(phrases, F.split(text, _SPLIT))
    df = df.withColumn(phrases, F.transform(phrases, lambda p: F.xxhash64(p)))
    wide = [f"aggregate({paragraphs}, 0L, (a, p) -> (a + (xxhash64({k}, p) & {MASK}L)) & {MASK}L)" for k in range(WIDE)]
    ones = [f"aggregate({phrases}, 0L, (a, h) -> a + (shiftrightunsigned(h, {k}) & {LANES}L))" for k in range(PAIRS)]
    return df.select(*columns, F.expr(f"array({', '.join([*wide, f'CAST(size({phrases}) AS BIGINT)', *ones])})").alias(name))


def shown(fingerprint: Column) -> Column:
    """A fingerprint as text: lanes of eight hexadecimal digits."""
    wide = [F.lpad(F.hex(fingerprint[k]), 8, "0") for k in range(WIDE)]
    rest = [F.lpad(F.hex(fingerprint[WIDE + k]), 16, "0") for k in range(1 + PAIRS)]
    return F.lower(F.concat(*wide, *rest))


def insert(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of both."""
    low = lambda x: x.bitwiseAND(MASK)
    high = lambda x: F.shiftrightunsigned(x, 32)
    wide = F.zip_with(F.slice(a, 1, WIDE + 1), F.slice(b, 1, WIDE + 1), lambda x, y: low(x + y))
    return F.concat(wide, F.zip_with(F.slice(a, WIDE + 2, PAIRS), F.slice(b, WIDE + 2, PAIRS), lambda x, y: F.shiftleft(low(high(x) + high(y)), 32).bitwiseOR(low(low(x) + low(y)))))


def delete(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` without the paragraphs of ``b``, which it has."""
    low = lambda x: x.bitwiseAND(MASK)
    high = lambda x: F.shiftrightunsigned(x, 32)
    wide = F.zip_with(F.slice(a, 1, WIDE + 1), F.slice(b, 1, WIDE + 1), lambda x, y: low(x - y))
    return F.concat(wide, F.zip_with(F.slice(a, WIDE + 2, PAIRS), F.slice(b, WIDE + 2, PAIRS), lambda x, y: F.shiftleft(low(high(x) - high(y)), 32).bitwiseOR(low(low(x) - low(y)))))


def _projection(df: DataFrame, fingerprint: str, name: str) -> DataFrame:
    lane = lambda x, n: F.lit(2.0) * x - n
    n = F.col(fingerprint)[WIDE]
    packed = F.slice(fingerprint, WIDE + 2, PAIRS)
    return df.withColumn(name, F.concat(F.transform(packed, lambda x: lane(x.bitwiseAND(MASK), n)), F.transform(packed, lambda x: lane(F.shiftrightunsigned(x, 32), n))))


def with_likeness(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with a column (0 to 1) for each pair of fingerprint columns: 1 for equal ones, else the cosine of their projections."""
    columns = df.columns
    used = sorted({c for pair in pairs.values() for c in pair})
    for c in used:
        df = _projection(df, c, f"__{c}_lanes")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    out = []
    for name, (a, b) in pairs.items():
        x, y = f"__{a}_lanes", f"__{b}_lanes"
        cosine = F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y)))
        out.append(F.when(F.col(a) == F.col(b), 1.0).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)), F.lit(0.0))).alias(name))
    return df.select(*columns, *out)


def with_next(docs: DataFrame, carried: list[str], buckets: int) -> DataFrame:
    """``docs`` with, for each of ``carried``, ``next_...`` of the next row by (doc_id, text); after the last row, the first.

    Rows are dealt into buckets of consecutive ids at quantiles of doc_id, so no task holds more than its share.
    The first row of each bucket is also put at the end of the bucket before it, where it ends that one's chain.
    """
    spark = docs.sparkSession
    found = docs.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 20 * buckets).alias("points")).head()
    points = sorted({found.least, *(found.points or [])} - {None})
    if not points:
        points = [0]
    bucket = F.size(F.filter(F.array(*map(F.lit, points)), lambda p: p <= F.col("doc_id"))) - 1
    heads = docs.where(F.col("doc_id").isin(points)).groupBy("doc_id").agg(F.min_by(F.struct(*carried), "text").alias("head")).select("doc_id", "head.*")
    before = (bucket + len(points) - 1) % len(points)
    every = docs.withColumn("bucket", bucket).withColumn("real", F.lit(True)).unionByName(heads.withColumn("bucket", before).withColumn("real", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy("bucket").orderBy(F.col("real").desc(), "doc_id", "text")
    return every.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carried)).where("real").drop("bucket", "real")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row of ``docs`` (doc_id, text) and of its edited text, with their likeness.

    In the edited text the last half of the characters gives way to as many (or all) from the start of the next
    document's text. A null text is empty: one empty paragraph. Rows without a doc_id are left out; rows that share
    one follow each other in the order of their texts. A single row is its own next.
    """
    spark = docs.sparkSession
    plain = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    marked = with_fingerprint(plain, "text", "fp")
    chained = with_next(marked, ["text", "fp"], 2 * runtime.shuffle_partitions(spark))
    sized = chained.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = sized.withColumn("edited", F.concat(F.expr("substring(text, 1, CAST(n_chars AS INT) - half)"), F.expr("substring(next_text, 1, half)")))
    edited = with_fingerprint(edited.select("doc_id", "n_chars", "fp", "next_fp", "edited"), "edited", "edited_fp")
    rated = with_likeness(edited, {"near_edited": ("fp", "edited_fp"), "near_next": ("fp", "next_fp")})
    return rated.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("fp")).alias("fingerprint"), shown(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")
