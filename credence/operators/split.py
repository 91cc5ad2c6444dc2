"""Train and test by date: later vintages are held out."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TimeSplit(NamedTuple):
    train: DataFrame
    test: DataFrame


def _moment(date: str) -> datetime:
    return datetime.fromisoformat(str(date))


def split_stats(loans: DataFrame, *, date_column: str, train_end_date: str, test_start_date: str) -> DataFrame:
    """One row: rows, first and last date, rows of train and test, rows without a date."""
    date = F.col(date_column).try_cast("timestamp_ntz")
    end, start = F.lit(_moment(train_end_date)).cast("timestamp_ntz"), F.lit(_moment(test_start_date)).cast("timestamp_ntz")
    return loans.agg(
        F.count(F.lit(1)).alias("rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.count_if(date <= end).alias("train_rows"), F.count_if(date >= start).alias("test_rows"),
        F.count_if(date.isNull()).alias("missing_dates"))


def time_split(loans: DataFrame, *, date_column: str, train_end_date: str, test_start_date: str, check: bool = True, year_column: str | None = None) -> TimeSplit:
    """Rows up to the train end (that moment included) and rows from the test start on.

    Rows between the two are in neither. The date column is dropped. With `check`, one
    aggregation finds missing dates and empty sides and raises ValueError. `year_column`: the
    year of the date, by which the table is partitioned; then each side reads just its years'
    files, and that column is dropped too.
    """
    if date_column not in loans.columns:
        raise KeyError(f"There is no date column `{date_column}`.")
    if _moment(train_end_date) >= _moment(test_start_date):
        raise ValueError("The train end must be before the test start.")
    if check:
        s = split_stats(loans, date_column=date_column, train_end_date=train_end_date, test_start_date=test_start_date).first()
        if s["missing_dates"]:
            raise ValueError(f"Column `{date_column}` has rows without a valid date.")
        if not s["train_rows"] or not s["test_rows"]:
            seen = f"Available date range is {s['first_date']:%Y-%m-%d} to {s['last_date']:%Y-%m-%d}. " if s["rows"] else "There are no rows. "
            raise ValueError(f"One side of the split has no rows. {seen}"
                             f"Rows by side: train {s['train_rows']}, test {s['test_rows']}.")
    date = F.col(date_column).try_cast("timestamp_ntz")
    end, start = _moment(train_end_date), _moment(test_start_date)
    of_train, of_test = date <= F.lit(end).cast("timestamp_ntz"), date >= F.lit(start).cast("timestamp_ntz")
    drop = [date_column]
    if year_column is not None:
        of_train, of_test = of_train & (F.col(year_column) <= end.year), of_test & (F.col(year_column) >= start.year)
        drop.append(year_column)
    return TimeSplit(loans.filter(of_train).drop(*drop), loans.filter(of_test).drop(*drop))
