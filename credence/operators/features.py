"""Feature engineering: narrow column expressions, raw columns kept beside the new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.functions import coerced

#: Lower bounds of the score bands; a band goes up to the next one's bound.
FICO_BANDS = ((0, "poor"), (580, "fair"), (670, "good"), (740, "very_good"), (800, "exceptional"))


def _require(loans: DataFrame, *columns: str) -> None:
    missing = sorted(set(columns) - set(loans.columns))
    if missing:
        raise KeyError(f"These columns are needed: {missing}")


def _ratio(a, b):
    """a / b, null where b is zero or either is missing."""
    return a / F.nullif(b, F.lit(0.0))


def add_dti(loans: DataFrame) -> DataFrame:
    _require(loans, "dti")
    return loans.withColumn("dti_clean", coerced(loans, "dti"))


def add_credit_utilization(loans: DataFrame) -> DataFrame:
    """From revol_util in percent where that column exists, else from the two totals.

    The choice is by column: a missing revol_util is not replaced by the totals.
    """
    if "revol_util" in loans.columns:
        used = coerced(loans, "revol_util") / F.lit(100.0)
    elif {"total_credit_utilized", "total_credit_limit"} <= set(loans.columns):
        used = _ratio(coerced(loans, "total_credit_utilized"), coerced(loans, "total_credit_limit"))
    else:
        raise KeyError("Utilisation needs `revol_util`, or `total_credit_utilized` with `total_credit_limit`.")
    return loans.withColumn("credit_utilization", used)


def add_fico_band(loans: DataFrame) -> DataFrame:
    """fico_midpoint and fico_band; no band for a negative, infinite or missing midpoint."""
    _require(loans, "fico_range_low", "fico_range_high")
    loans = loans.withColumn("fico_midpoint", (coerced(loans, "fico_range_low") + coerced(loans, "fico_range_high")) / F.lit(2.0))
    middle = F.col("fico_midpoint")
    band = F.when(middle.isNull() | F.isnan(middle) | (middle == float("inf")), F.lit(None).cast("string"))
    for low, name in reversed(FICO_BANDS):
        band = band.when(middle >= low, F.lit(name))
    return loans.withColumn("fico_band", band)


def add_loan_to_income(loans: DataFrame) -> DataFrame:
    _require(loans, "loan_amnt", "annual_inc")
    return loans.withColumn("loan_to_income_ratio", _ratio(coerced(loans, "loan_amnt"), coerced(loans, "annual_inc")))


def feature_matrix(loans: DataFrame) -> DataFrame:
    """All features; the score band only where its columns are, and an error if one is alone."""
    loans = loans.transform(add_dti).transform(add_credit_utilization)
    if {"fico_range_low", "fico_range_high"} & set(loans.columns):
        loans = loans.transform(add_fico_band)
    return loans.transform(add_loan_to_income)
