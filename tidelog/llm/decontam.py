"""Benchmark decontamination: windows of benchmark words looked up in every document, in DataFrame functions only.

A window is WINDOW consecutive words of a benchmark item, or all words of a shorter item. Hashes of four words of
each window (its first, its last and two between) form a hash set that every executor gets with its tasks, if the
windows are BOUND at most and have BOUND_BYTES at most with the items that hold them; each document's positions are
looked up in it without leaving the row. What the set lets through is verified: the whole window's words are joined with
the benchmark's windows. Beyond the bounds the hashes of all positions are joined with the set of hashes instead,
without a broadcast; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime
from .places import at_rest, place

WINDOW = 13
#: Windows that may be sent to every executor, and bytes of their words and items.
BOUND = 50_000
BOUND_BYTES = 32 << 20
#: Bytes of hits that may be sent to every executor.
HIT_BYTES = 16 << 20
#: A document is contaminated when a window's words are at least one in so many of its words.
SHARE = 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lowering.
SEPARATOR_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lowered and nothing else; for a text of ASCII characters that is what lower() does, at a fraction of the cost."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def _probe(array: str, at: str, length: int) -> str:
    """SQL for the hash of up to four words of the window of ``length`` at ``at``."""
    picks = sorted({0, (length - 1) // 3, 2 * (length - 1) // 3, length - 1})
    return f"xxhash64({length}, {', '.join(f'{array}[{at} + {p}]' for p in picks)})"


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(gram, len, items) of the distinct windows of ``benchmark`` (item_id, text)."""
    listed = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0").withColumn("len", F.expr(f"least(size(w), {WINDOW})"))
    each = listed.select("item", "w", "len", F.explode(F.expr("sequence(0, size(w) - len)")).alias("i"))
    grams = each.select("item", "len", F.concat_ws(" ", F.expr("slice(w, i + 1, len)")).alias("gram"))
    return grams.groupBy("gram", "len").agg(F.collect_set("item").alias("items"))


def _probes(windows: DataFrame) -> DataFrame:
    """(len, probe) of the windows."""
    w = windows.select("len", F.split("gram", " ").alias("w"))
    by_length = None
    for length in range(1, WINDOW + 1):
        own = F.when(F.col("len") == length, F.expr(f"CASE WHEN len = {length} THEN {_probe('w', '0', length)} END"))
        by_length = own if by_length is None else F.coalesce(by_length, own)
    return w.select("len", by_length.alias("probe")).distinct()


def find_hits(docs: DataFrame, benchmark: DataFrame, carried: list, bound: int = BOUND, hit_only: bool = False) -> DataFrame:
    """A row for each row of ``docs`` (with ``text``): row (a struct of ``carried``), n_words, spans (pos, len) and items.

    Rows are told apart by their place in the input, so repeated rows and ids are each answered. With ``hit_only``
    rows without a hit are left out, and those without a candidate are not shuffled.
    """
    windows = runtime.stored(benchmark_windows(benchmark), "windows")
    held = F.octet_length("gram") + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x))
    size = windows.agg(F.count("*").alias("n"), F.sum(held).alias("bytes"), F.collect_set("len").alias("lengths")).head()
    lengths = sorted(size["lengths"])
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*carried).alias("row"), words(F.col("text")).alias("w"))
    base = base.withColumn("n_words", F.size("w").cast("long"))
    explode = F.explode if hit_only else F.explode_outer
    if size["n"] <= bound and (size["bytes"] or 0) <= BOUND_BYTES:
        # BOUND bounds what is collected and broadcast here.
        probes, found = _probes(windows).collect(), []
        for length in lengths:
            known = ", ".join(f"{r.probe}L" for r in probes if r["len"] == length)
            known = known.replace("-9223372036854775808L", "(-9223372036854775807L - 1L)")
            picked = f"filter(sequence(0, size(w) - {length}), i -> {_probe('w', 'i', length)} IN ({known}))"
            found.append(f"CASE WHEN size(w) >= {length} THEN transform({picked}, i -> struct(i AS pos, {length} AS len)) ELSE array() END")
        candidates = F.expr(f"concat({', '.join(found)})") if found else F.expr("CAST(array() AS array<struct<pos:int,len:int>>)")
        spotted = base.withColumn("candidates", candidates)
        spread = spotted.select("rid", "row", "n_words", "w", explode("candidates").alias("span"))
        windows = F.broadcast(windows)
    else:
        tried = [f"CASE WHEN size(w) >= {n} THEN transform(sequence(0, size(w) - {n}), i -> struct({n} AS len, {_probe('w', 'i', n)} AS probe, i AS pos)) ELSE array() END" for n in lengths]
        places = base.select("rid", F.explode(F.expr(f"concat({', '.join(tried)})")).alias("p")).select("rid", "p.*")
        places = places.join(_probes(windows), ["len", "probe"], "left_semi").select("rid", F.struct("pos", "len").alias("span"))
        spread = base.join(places, "rid", "inner" if hit_only else "left").select("rid", "row", "n_words", "w", "span")
    tested = spread.select("rid", "row", "n_words", "span", F.when(F.col("span").isNotNull(), F.concat_ws(" ", F.expr("slice(w, span.pos + 1, span.len)"))).alias("gram"), F.col("span.len").alias("len"))
    joined = tested.join(windows, ["gram", "len"], "inner" if hit_only else "left").withColumn("hit", F.when(F.col("items").isNotNull(), F.col("span")))
    grouped = joined.groupBy("rid").agg(F.first("row").alias("row"), F.first("n_words").alias("n_words"), F.collect_set("hit").alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return grouped.select("row", "n_words", "spans", "items")


def _hit_words() -> Column:
    return F.expr("array_distinct(flatten(transform(spans, s -> sequence(s.pos, s.pos + s.len - 1))))")


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, bound: int = BOUND) -> DataFrame:
    """What each row of ``docs`` (doc_id, text) shares with ``benchmark`` (item_id, text).

    A null text has no words. With no benchmark item nothing is hit; items without words have no windows. An empty table
    gives an empty one; a row without a doc_id is answered under a null one; a very long text is one array of words.
    """
    found = find_hits(docs, benchmark, ["doc_id"], bound).withColumn("n_hit", F.size(_hit_words()).cast("long"))
    listed = F.concat_ws(",", F.array_sort("items"))
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), contaminated().alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, bound: int = BOUND) -> DataFrame:
    """``docs`` without contaminated rows; from the others the hit words go, with what stands between them.

    Columns stay as they are (``n_chars``, if there, is counted anew where the text changed); a null text stays null.
    Hits are found first and stored by the place of their rows; a second scan meets them there, by a broadcast if they
    have HIT_BYTES at most, so that texts are not shuffled; else by a join on the place.
    """
    docs = at_rest(docs)
    columns = docs.columns
    found = find_hits(docs, benchmark, place(docs), bound, hit_only=True)
    hits = found.withColumn("hit", _hit_words()).withColumn("n_hit", F.size("hit").cast("long"))
    hits = runtime.stored(hits.select("row.*", F.col("hit").alias("__hit"), contaminated().alias("__gone")), "hits")
    size = hits.agg(F.sum(64 + 4 * F.size("__hit"))).head()[0] or 0
    hits = F.broadcast(hits) if size <= HIT_BYTES else hits
    met = docs.select(*place(docs), F.struct(*(docs[c] for c in columns)).alias("row")).join(hits, ["__f", "__r"], "left").where(~F.coalesce("__gone", F.lit(False)))
    changed = F.col("__hit").isNotNull()
    cut = met.withColumn("ow", F.when(changed, F.array_remove(F.split("row.text", SEPARATOR_ANY_CASE), ""))).withColumn("os", F.when(changed, F.split("row.text", WORD_ANY_CASE)))
    kept = "transform(sequence(0, size(ow) - 1), j -> concat(CASE WHEN array_contains(__hit, j) THEN '' ELSE ow[j] END, CASE WHEN array_contains(__hit, j) AND array_contains(__hit, j + 1) THEN '' ELSE os[j + 1] END))"
    text = F.when(changed, F.concat(F.col("os")[0], F.array_join(F.expr(kept), ""))).otherwise(F.col("row.text"))
    # The text is made once, for itself and for its length.
    cleaned = cut.withColumn("clean", text)
    new = {"text": F.col("clean"), "n_chars": F.when(changed, F.char_length("clean").cast(dict(docs.dtypes).get("n_chars", "long"))).otherwise(F.col("row.n_chars")) if "n_chars" in columns else None}
    return cleaned.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in columns))
