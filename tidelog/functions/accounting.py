"""What work costs: percentiles of latencies, amplification, bytes handed in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import before_parts, with_range


def rank_percentile(values: DataFrame, column: str, quantiles: list[float]) -> DataFrame:
    """(quantile, value): of n ascending values that at place floor(q * (n - 1)), places from 0.

    Equal values are counted first; distinct values are dealt into ranges and ranked within them, after the sum of
    the ranges before.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("c"))
    ranged = with_range(counts, "value", int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    totals = ranged.groupBy("part").agg(F.sum("c").alias("c"))
    # A row for each range.
    starts = before_parts(totals, "part", "c").join(F.broadcast(totals.agg(F.sum("c").alias("n"))), how="cross")
    w = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.withColumn("upto", F.sum("c").over(w)).join(F.broadcast(starts), "part")
    place = lambda q: F.floor(q * (F.col("n") - 1)) - F.col("before")
    mine = F.filter(F.array(*(F.lit(float(q)) for q in quantiles)), lambda q: (place(q) < F.col("upto")) & (place(q) >= F.col("upto") - F.col("c")))
    return ranked.select(F.explode(mine).alias("quantile"), "value")


def bytes_handed_in(key: str = "key", value: str = "value") -> Column:
    """Bytes of keys and values, as an aggregate."""
    return F.sum(F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)))


def amplification(written: dict[str, int], handed_in: int, on_disk: int) -> dict[str, float]:
    """Bytes written for each byte handed in, by kind and in all, and bytes on disk for each."""
    per = max(1, handed_in)
    return {f"write_{k}": v / per for k, v in written.items()} | {"write": sum(written.values()) / per, "space": on_disk / per}
