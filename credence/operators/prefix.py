"""Exact running totals over a global order, without a single-task window.

Rows are dealt into ranges by boundaries taken once as literals, so a recomputation deals
them alike; totals per range are a handful of rows; the running total within a range is a
window over that range, and the offset of the ranges before is added. Totals of integers
are exact and do not depend on the boundaries. The number of ranges follows the number of
rows, so that a range stays within what one task sorts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_RANGES = 64
#: Rows of a range, about.
RANGE_ROWS = 2_000_000


@dataclass(frozen=True)
class Profile:
    """What one pass over a table of distinct values tells: rows, sums of columns, boundaries."""

    rows: int
    sums: dict[str, int]
    marks: list[float]


def _marks(column: str, ranges: int):
    return F.percentile_approx(column, [k / ranges for k in range(1, ranges)], max(10_000, 20 * ranges)).alias("marks")


def profile(rows: DataFrame, column: str, summed: Sequence[str] = (), ranges: int | None = None) -> Profile:
    """One aggregation; a second one only where so many rows need more ranges."""
    first = ranges or LEAST_RANGES
    asked = [F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(f"sum_{k}") for k, c in enumerate(summed)]]
    found = rows.agg(*asked, *([_marks(column, first)] if first > 1 else [])).first().asDict()
    marks = found.get("marks") or []
    if ranges is None and (need := -(-found["rows"] // RANGE_ROWS)) > first:
        marks = rows.agg(_marks(column, need)).first()["marks"] or []
    return Profile(found["rows"], {c: found[f"sum_{k}"] or 0 for k, c in enumerate(summed)}, sorted(set(marks)))


def with_range(rows: DataFrame, column: str, marks: list[float], name: str = "_range") -> DataFrame:
    """`rows` with how many of the marks are at or below the value, found by binary search."""
    if not marks:
        return rows.withColumn(name, F.lit(0))
    splits = [-float("inf"), *marks, float("inf")]
    if splits[1] == -float("inf") or splits[-2] == float("inf"):  # infinite values are marks themselves
        splits = sorted(set(splits))
    if len(splits) < 3:
        return rows.withColumn(name, F.lit(0))
    dealt = Bucketizer(splits=splits, inputCol=column, outputCol=name, handleInvalid="keep").transform(rows)
    return dealt.withColumn(name, F.col(name).cast("int"))


def running_totals(rows: DataFrame, column: str, totals: dict[str, str], *, descending: bool = False, ranges: int | None = None,
                   known: Profile | None = None) -> DataFrame:
    """`rows`, of distinct values of `column`, plus running totals: new name -> summed column."""
    marks = (known or profile(rows, column, ranges=ranges)).marks
    ranged = with_range(rows, column, marks)
    sums = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{name}") for name, c in totals.items()])
    order = F.desc if descending else F.asc
    before = Window.orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    offsets = sums.select(F.col("_range"), *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in totals])
    within = Window.partitionBy("_range").orderBy(order(column)).rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.select("*", *[F.sum(c).over(within).alias(name) for name, c in totals.items()])
    # every range has its offset; a left join keeps the range's expression out of the scans' filters
    joined = ranged.join(F.broadcast(offsets), "_range", "left")
    return joined.withColumns({name: F.col(name) + F.col(f"_{name}") for name in totals}).drop("_range", *[f"_{n}" for n in totals])
