"""Which loans are closed, and whether they defaulted."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Loan statuses that are outcomes.
PAID_STATUSES = ("Fully Paid", "Does not meet the credit policy. Status:Fully Paid")
DEFAULT_STATUSES = ("Charged Off", "Default", "Does not meet the credit policy. Status:Charged Off")
CLOSED_STATUSES = PAID_STATUSES + DEFAULT_STATUSES


def _tidy(status: str):
    # the pattern trims any white space, not blanks alone
    return F.lower(F.regexp_replace(F.col(status).cast("string"), r"^\s+|\s+$", ""))


def _lower(statuses: Iterable[str]) -> list[str]:
    return sorted({s.strip().lower() for s in statuses})


def closed_loans(loans: DataFrame, *, closed_statuses: Iterable[str] = CLOSED_STATUSES,
                 status_column: str = "loan_status") -> DataFrame:
    """Rows whose status, case and outer blanks aside, is a closed one; null is not."""
    if status_column not in loans.columns:
        raise KeyError(f"Column `{status_column}` is missing.")
    return loans.filter(_tidy(status_column).isin(*_lower(closed_statuses)))


def default_target(loans: DataFrame, *, status_column: str = "loan_status", target_column: str = "default_flag") -> DataFrame:
    """Adds 1 for a default, 0 for a paid loan, null for any other status."""
    if status_column not in loans.columns:
        raise KeyError(f"There is no column `{status_column}` to label by.")
    status = _tidy(status_column)
    return loans.withColumn(target_column, F.when(status.isin(*_lower(DEFAULT_STATUSES)), F.lit(1))
                            .when(status.isin(*_lower(PAID_STATUSES)), F.lit(0)).cast("int"))


def with_target(loans: DataFrame, target_column: str = "default_flag") -> DataFrame:
    """Rows that have a target."""
    return loans.dropna(subset=[target_column])
