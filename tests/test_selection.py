"""Order statistics by narrowing brackets, against sorted values."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from credence.operators import selection


@pytest.mark.parametrize("options", [{}, {"fits": 5, "marks": 7, "share": 0.1}, {"fits": 0, "marks": 3, "share": 0.0}])
def test_medians(spark, options):
    rng = random.Random(1)
    inf = float("inf")
    columns = [
        [rng.gauss(0, 1) for _ in range(400)], [float(rng.randrange(3)) for _ in range(399)], [7.0] * 10, [1.0, 2.0], [3.0], [], [-inf, 0.0, inf, inf],
        [rng.choice([None, -1e300, 1e300, 0.0, 5e-324]) for _ in range(200)], [rng.expovariate(1) ** 9 for _ in range(401)]]
    height = max(map(len, columns))
    rows = spark.createDataFrame([tuple(c[i] if i < len(c) else None for c in columns) for i in range(height)], ", ".join(f"c{k} double" for k in range(len(columns))))
    got = selection.medians(rows.repartition(3), [F.col(f"c{k}") for k in range(len(columns))], **options)
    want = {k: statistics.median(own) for k, c in enumerate(columns) if (own := [x for x in c if x is not None])}
    assert got == pytest.approx(want)


def test_marks_that_are_off_cost_a_pass_only():
    bracket = selection.Bracket(0, 10.0, 20.0)
    assert selection._next(bracket, 3, 5, 1, 4, 1, [], 10) == (None, selection.Bracket(0, None, 10.0), -1)
    assert selection._next(bracket, 5, 5, 1, 4, 1, [], 10) == (10.0, None, -1)
    assert selection._next(bracket, 8, 5, 1, 4, 1, [], 10) == (None, bracket, 2)
    assert selection._next(bracket, 10, 5, 1, 4, 1, [], 10) == (20.0, None, -1)
    assert selection._next(bracket, 11, 5, 1, 4, 1, [], 10) == (None, selection.Bracket(0, 20.0, None), -1)
    assert selection._next(bracket, 56, 5, 1, 100, 1, [12.0, 14.0, 16.0, 18.0], 10) == (None, selection.Bracket(0, 12.0, 18.0), -1)


def test_only_the_bracket_is_shuffled(spark):
    """A pass moves one row of each task; the values that are shuffled are those of the bracket."""
    rows = spark.range(200_000, numPartitions=4).select((F.col("id") * 7919 % 200_000).cast("double").alias("x"))
    bracket = selection.Bracket(0, 99_000.0, 101_000.0)
    found = selection._sorted(rows, [F.col("x")], {bracket: [999]})
    assert found == {(bracket, 999): 100_000.0}
    assert selection.medians(rows, [F.col("x")]) == {0: 99_999.5}
