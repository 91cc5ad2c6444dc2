"""Isotonic fits that merge: blocks as the convex minorant of running sums.

The isotonic fit of scores in order is the slope of the greatest convex minorant of the points
(rows so far, positives so far). A minorant is a chain of blocks with rising rates. Chains of
neighbouring ranges merge to the chain of both: blocks at the end of the left one and at the start
of the right one become one block, whose rate is the root of a falling function, and the
others stay. So each range makes its chain on its own, and chains are merged in a tree.

A chain is small: rates that rise are different fractions, and a block of rate p / q has at
least q rows, so a chain of n rows has about 0.9 * n ** (2 / 3) blocks at the most, some
900,000 for 10 ** 9 rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.operators.prefix import profile, with_range

#: Neighbouring scores that are pooled together before chains are merged.
SEGMENT = 256
#: Chains that one task merges.
FAN = 16


@dataclass
class Chain:
    """Blocks in order: their first and last score, positives and rows; rates rise."""

    first: np.ndarray
    last: np.ndarray
    positives: np.ndarray
    total: np.ndarray

    @property
    def rate(self) -> np.ndarray:
        return self.positives / self.total

    def __len__(self) -> int:
        return len(self.total)

    def part(self, start: int, end: int) -> Chain:
        return Chain(*(x[start:end] for x in (self.first, self.last, self.positives, self.total)))


def _joined(chains: Iterable[Chain]) -> Chain:
    chains = list(chains)
    return Chain(*(np.concatenate([getattr(c, name) for c in chains]) for name in ("first", "last", "positives", "total")))


def _pooled_within(held: Chain, size: int) -> tuple[Chain, np.ndarray]:
    """Falling runs pooled until rates rise within segments of `size` neighbours, all segments at once; and each block's segment."""
    segment = np.arange(len(held)) // size
    while True:
        rate = held.rate
        falls = (rate[:-1] >= rate[1:]) & (segment[:-1] == segment[1:])
        if not falls.any():
            return held, segment
        start = np.flatnonzero(np.append(True, ~falls))
        end = np.append(start[1:], len(rate)) - 1
        held = Chain(held.first[start], held.last[end], np.add.reduceat(held.positives, start), np.add.reduceat(held.total, start))
        segment = segment[start]


def merged(left: Chain, right: Chain) -> Chain:
    """The chain of two neighbouring ranges."""
    if not len(left) or not len(right):
        return left if len(left) else right
    a, b = left.rate, right.rate
    if a[-1] < b[0]:
        return _joined([left, right])
    # what a level m would pool: the left blocks at or above m, the right ones at or below
    over = [np.append(np.cumsum(x[::-1])[::-1], 0) for x in (left.positives, left.total)]
    under = [np.append(0, np.cumsum(x)) for x in (right.positives, right.total)]
    levels = np.unique(np.concatenate([a[np.searchsorted(a, b[0]) :], b[: np.searchsorted(b, a[-1], side="right")]]))
    i, j = np.searchsorted(a, levels), np.searchsorted(b, levels, side="right")
    excess = over[0][i] + under[0][j] - levels * (over[1][i] + under[1][j])
    # it falls with the level and is not below 0 at the first one
    level = levels[max(0, np.count_nonzero(excess >= 0) - 1)]
    i, j = int(np.searchsorted(a, level, side="right")), int(np.searchsorted(b, level, side="right"))
    if i == len(a):
        i = int(np.searchsorted(a, level))  # the root is the level itself
    pool = Chain(left.first[i : i + 1], right.last[j - 1 : j] if j else left.last[-1:], np.array([over[0][i] + under[0][j]]), np.array([over[1][i] + under[1][j]]))
    return _joined([left.part(0, i), pool, right.part(j, len(right))])


def chain(score: np.ndarray, positives: np.ndarray, total: np.ndarray, segment: int = SEGMENT) -> Chain:
    """The chain of scores in ascending order."""
    positives, total = positives.astype(np.int64), total.astype(np.int64)
    held, own = _pooled_within(Chain(score, score, positives, total), segment)
    cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(held) else np.zeros(0, int)
    chains = [held.part(s, e) for s, e in zip(cuts, [*cuts[1:], len(held)])]
    return in_tree(chains) if chains else held


def in_tree(chains: list[Chain]) -> Chain:
    """Neighbours merged pairwise until one is left."""
    while len(chains) > 1:
        chains = [merged(*chains[k : k + 2]) if k + 1 < len(chains) else chains[k] for k in range(0, len(chains), 2)]
    return chains[0]


_CHAIN = "range int, first double, last double, positives bigint, total bigint"


def _frame(number: int, held: Chain) -> pd.DataFrame:
    return pd.DataFrame({"range": np.full(len(held), number, np.int32), "first": held.first, "last": held.last, "positives": held.positives, "total": held.total})


def minorant(counts: DataFrame, *, score: str = "score", ranges: int | None = None) -> DataFrame:
    """(range, first, last, positives, total): the blocks of a table of distinct scores with positives and totals."""
    marks = profile(counts, score, ranges=ranges).marks

    def of_range(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(score)
        return _frame(table["_range"].iloc[0], chain(table[score].to_numpy(), table["positives"].to_numpy(), table["total"].to_numpy()))

    def of_chains(table: pd.DataFrame) -> pd.DataFrame:
        held = [Chain(*(own[c].to_numpy() for c in ("first", "last", "positives", "total"))) for _, own in table.sort_values(["range", "first"]).groupby("range")]
        return _frame(table["range"].iloc[0] // FAN, in_tree(held))

    rows = with_range(counts.select(score, "positives", "total"), score, marks).groupBy("_range").applyInPandas(of_range, _CHAIN)
    left = len(marks) + 1
    while left > 1:
        rows = rows.groupBy(F.floor(F.col("range") / FAN)).applyInPandas(lambda table: of_chains(table), _CHAIN)
        left = -(-left // FAN)
    return rows


@dataclass
class IsotonicCalibrator:
    """Points of a piecewise linear map, constant beyond its ends."""

    points: np.ndarray
    values: np.ndarray

    def transform(self, rows: DataFrame, score: str = "_score", output: str = "_calibrated") -> DataFrame:
        points, values = self.points, self.values

        @F.arrow_udf("double")
        def calibrated(x: pa.Array) -> pa.Array:
            return pa.array(np.interp(x.fill_null(0.0).to_numpy(zero_copy_only=False), points, values), pa.float64(), mask=np.asarray(x.is_null()))

        return rows.withColumn(output, calibrated(F.col(score).cast("double")))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(pd.DataFrame({"score": self.points, "rate": self.values})).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> IsotonicCalibrator:
        held = spark.read.parquet(path).orderBy("score").toPandas()
        return IsotonicCalibrator(held["score"].to_numpy(), held["rate"].to_numpy())


def fit_isotonic(counts: DataFrame, *, score: str = "score", ranges: int | None = None) -> IsotonicCalibrator:
    """The isotonic fit of a table of distinct scores; blocks are brought to the driver, whose number has the bound above."""
    blocks = minorant(counts, score=score, ranges=ranges).orderBy("first").toPandas()
    if not len(blocks):
        raise ValueError("There are no scores to calibrate on.")
    rate = (blocks["positives"] / blocks["total"]).to_numpy()
    first, last = blocks["first"].to_numpy(), blocks["last"].to_numpy()
    points, values = np.stack([first, last], axis=1).ravel(), np.repeat(rate, 2)
    keep = np.append(True, np.diff(points) > 0)
    return IsotonicCalibrator(points[keep], values[keep])
