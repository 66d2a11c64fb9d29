"""Consecutive ranges of a column's values, for work that needs an order but no single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values that are looked at for each range, to place its ends.
LOOKED_AT = 50


def with_range(rows: DataFrame, column: str, n: int, name: str = "part") -> DataFrame:
    """``rows`` with the number of the range that ``column`` lies in.

    The ends of ranges are values of the column itself: those with a hash in a share of all hashes, so about
    LOOKED_AT for each range. They are literals of the plan, so every use of the result sees the same ranges. Where they
    lie decides how even ranges are, never what comes out. Distinct values are dealt evenly; of one value all rows
    are in one range.
    """
    values = rows.select(F.col(column).alias("v")).where("v IS NOT NULL")
    total = values.count()
    share = max(1, total // (n * LOOKED_AT))
    seen = sorted({bytes(r["v"]) if isinstance(r["v"], bytearray) else r["v"] for r in values.where(F.pmod(F.xxhash64("v"), F.lit(share)) == 0).distinct().collect()})
    ends = sorted({seen[len(seen) * k // n] for k in range(1, n)}) if seen else []
    place = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col(column))) if ends else F.lit(0)
    return rows.withColumn(name, place)


def before_parts(totals: DataFrame, part: str, amount: str) -> DataFrame:
    """(part, before): the sum of ``amount`` over smaller parts; ``totals`` has a row for each part."""
    return totals.select(part, F.coalesce(F.sum(amount).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
