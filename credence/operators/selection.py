"""Exact order statistics of many columns at once, by narrowing brackets.

A rank is looked for between two values of its column. A pass over the rows counts, for each
bracket, the values below it, at its ends and inside; that tells where the rank lies. When a
bracket has so few values that one task can sort them, they alone are shuffled; for one that
has more a second pass takes marks inside, so that the next bracket is a few hundredths of
it. Passes are plain aggregations, a row for each task, and those that count are compiled whole. The marks are approximate, the counts are
not: a mark that is off costs a pass, never the answer.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A bracket with at most so many values is sorted by one task.
FITS = 1_000_000
#: The first bracket lies so far around the rank, as a share of the rows.
FIRST_SHARE = 0.0015
MARKS = 200
ACCURACY = 10_000


@dataclass(frozen=True)
class Bracket:
    """Values of a column above `low` and below `high`; None: without an end there."""

    column: int
    low: float | None
    high: float | None

    def holds(self, value: Column) -> Column:
        inside = value.isNotNull()
        inside = inside & (value > self.low) if self.low is not None else inside
        return inside & (value < self.high) if self.high is not None else inside


def _counts(k: int, bracket: Bracket, value: Column) -> list[Column]:
    low, high = bracket.low, bracket.high
    none = F.lit(0).cast("bigint")
    return [
        (F.count_if(value < low) if low is not None else none).alias(f"below{k}"), (F.count_if(value == low) if low is not None else none).alias(f"low{k}"),
        F.count_if(bracket.holds(value)).alias(f"inside{k}"), (F.count_if(value == high) if high is not None and high != low else none).alias(f"high{k}")]


def _marked(k: int, bracket: Bracket, value: Column, marks: int) -> Column:
    return F.percentile_approx(F.when(bracket.holds(value), value), [i / (marks + 1) for i in range(1, marks + 1)], ACCURACY).alias(f"marks{k}")


def _dense(rank: int, below: int, low: int, inside: int, fits: int) -> bool:
    """Whether the rank is inside the bracket, with too many others to sort them."""
    return 0 <= rank - below - low < inside and inside > fits


def _next(bracket: Bracket, rank: int, below: int, low: int, inside: int, high: int, marks: list[float], fits: int) -> tuple[float | None, Bracket | None, int]:
    """The value if the counts tell it, else the bracket that has the rank, and its place inside if it can be sorted (else -1)."""
    if rank < below:
        return None, Bracket(bracket.column, None, bracket.low), -1
    if rank < below + low:
        return bracket.low, None, -1
    place = rank - below - low
    if place >= inside:
        return (bracket.high, None, -1) if place < inside + high else (None, Bracket(bracket.column, bracket.high, None), -1)
    if inside <= fits:
        return None, bracket, place
    at = place * (len(marks) + 1) // inside
    ends = [bracket.low if at < 2 else marks[at - 2], bracket.high if at + 1 >= len(marks) else marks[at + 1]]
    return None, Bracket(bracket.column, *ends), -1


def _sorted(rows: DataFrame, values: list[Column], wanted: dict[Bracket, list[int]]) -> dict[tuple[Bracket, int], float]:
    """The values at places of brackets that one task can sort each."""
    brackets = list(wanted)
    every = F.array(*[F.when(b.holds(values[b.column]), F.struct(F.lit(k).alias("b"), values[b.column].alias("value"))) for k, b in enumerate(brackets)])
    inside = rows.select(F.explode(F.filter(every, lambda x: x.isNotNull())).alias("s")).select("s.*").groupBy("b", "value").agg(F.count(F.lit(1)).alias("n"))
    until = F.sum("n").over(Window.partitionBy("b").orderBy("value"))
    asked = F.create_map(*[x for k, b in enumerate(brackets) for x in (F.lit(k), F.array(*[F.lit(p).cast("bigint") for p in wanted[b]]))])
    found = (inside.select("b", "value", (until - F.col("n")).alias("start"), until.alias("until"))
             .withColumn("places", F.filter(F.element_at(asked, F.col("b")), lambda p: (p >= F.col("start")) & (p < F.col("until"))))
             .filter(F.size("places") > 0).collect())  # a row per place at most
    return {(brackets[r["b"]], p): r["value"] for r in found for p in r["places"]}


def values_at_ranks(rows: DataFrame, values: list[Column], wanted: Any, *, fits: int = FITS, share: float = FIRST_SHARE, marks: int = MARKS) -> dict[int, dict[int, float]]:
    """For each column (a double) the values at some ranks from 0 of its non-null values, ascending.

    `wanted`: a function of the number of non-null values to ranks. A column without values has none.
    """
    if not values:
        return {}
    # the first marks lie around the middle of the ranks that a small column's number gives
    guess = [r / 1_000_000 for r in wanted(1_000_001)]
    around = sorted({min(1.0, max(0.0, g + d)) for g in guess for d in (-share, share)})
    first = rows.agg(*[x for k, v in enumerate(values) for x in (F.count(v).alias(f"n{k}"), F.percentile_approx(v, around, ACCURACY).alias(f"m{k}"))]).first()
    out: dict[int, dict[int, float]] = {k: {} for k in range(len(values))}
    open_: list[tuple[Bracket, int]] = []
    for k in range(len(values)):
        for rank in wanted(first[f"n{k}"]) if first[f"n{k}"] else ():
            open_.append((Bracket(k, first[f"m{k}"][0], first[f"m{k}"][-1]), rank))
    small: dict[Bracket, list[int]] = {}
    ranks: dict[tuple[Bracket, int], list[int]] = {}
    while open_:
        brackets = list(dict.fromkeys(b for b, _ in open_))
        found = rows.agg(*[x for k, b in enumerate(brackets) for x in _counts(k, b, values[b.column])]).first()
        dense = sorted({k for k, rank in ((brackets.index(b), rank) for b, rank in open_) if _dense(rank, *(found[f"{x}{k}"] for x in ("below", "low", "inside")), fits)})
        inner = rows.agg(*[_marked(k, brackets[k], values[brackets[k].column], marks) for k in dense]).first().asDict() if dense else {}
        still = []
        for bracket, rank in open_:
            k = brackets.index(bracket)
            value, now, place = _next(bracket, rank, *(found[f"{x}{k}"] for x in ("below", "low", "inside", "high")), inner.get(f"marks{k}") or [], fits)
            if value is not None:
                out[bracket.column][rank] = value
            elif place < 0:
                still.append((now, rank))
            else:
                small.setdefault(now, []).append(place)
                ranks.setdefault((now, place), []).append(rank)
        open_ = still
    if small:
        for (bracket, place), value in _sorted(rows, values, small).items():
            for rank in ranks[bracket, place]:
                out[bracket.column][rank] = value
    return out


def medians(rows: DataFrame, values: list[Column], **options) -> dict[int, float]:
    """The exact median of each column, by its place: halfway between the two middle values."""
    middle = lambda n: sorted({(n - 1) // 2, n // 2})
    out = {}
    for k, found in values_at_ranks(rows, values, middle, **options).items():
        if found:
            low, high = min(found.values()), max(found.values())
            out[k] = low if low == high else 0.5 * low + 0.5 * high
    return out
