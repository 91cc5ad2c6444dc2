"""Leakage controls: which columns were known when the loan was granted.

Names are matched exactly; only the renaming of source columns ignores case.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Columns known at origination, in the policy's order.
ORIGINATION_COLUMNS = (
    "loan_amnt", "term", "int_rate", "installment", "grade", "sub_grade", "emp_length",
    "home_ownership", "annual_inc", "verification_status", "issue_d", "purpose", "addr_state",
    "dti", "delinq_2yrs", "earliest_cr_line", "fico_range_low", "fico_range_high",
    "inq_last_6mths", "open_acc", "pub_rec", "revol_bal", "revol_util",
    "total_credit_utilized", "total_credit_limit", "total_acc",
)
ORIGINATION_REASON = "Borrower or loan attribute available at underwriting time."

#: Columns known only later, with the reason.
POST_ORIGINATION_COLUMNS = {
    "loan_status": "Terminal outcome used to construct the target.",
    "pymnt_plan": "Can reflect servicing behavior after origination.",
    "out_prncp": "Outstanding principal is only known after payments occur.",
    "out_prncp_inv": "Outstanding investor principal is post-origination.",
    "total_pymnt": "Total payments are accumulated after origination.",
    "total_pymnt_inv": "Investor payments are accumulated after origination.",
    "total_rec_prncp": "Principal received is post-origination payment history.",
    "total_rec_int": "Interest received is post-origination payment history.",
    "total_rec_late_fee": "Late fees reveal repayment behavior.",
    "recoveries": "Recoveries occur after default or charge-off.",
    "collection_recovery_fee": "Collection fees occur after delinquency or default.",
    "last_pymnt_d": "Last payment date is post-origination.",
    "last_pymnt_amnt": "Last payment amount is post-origination.",
    "next_pymnt_d": "Next payment date is servicing information.",
    "last_credit_pull_d": "Credit pulls after origination may leak future state.",
    "last_fico_range_high": "Updated FICO score is measured after origination.",
    "last_fico_range_low": "Updated FICO score is measured after origination.",
    "collections_12_mths_ex_med": "May be reported after origination depending on extract timing.",
    "policy_code": "May encode lender policy changes rather than borrower risk.",
}


def leakage_policy(spark: SparkSession) -> DataFrame:
    """The policy as a table: the origination columns first, then the later ones."""
    rows = [(c, True, ORIGINATION_REASON) for c in ORIGINATION_COLUMNS]
    rows += [(c, False, reason) for c, reason in POST_ORIGINATION_COLUMNS.items()]
    return spark.createDataFrame(rows, "column string, available_at_origination boolean, reason string")


def post_origination_columns(columns: Iterable[str]) -> list[str]:
    """Those of the columns that were not known at origination, in the given order."""
    return [c for c in columns if c in POST_ORIGINATION_COLUMNS]


def exclude_leaky_columns(loans: DataFrame, *, keep_columns: Iterable[str] = ("default_flag",)) -> DataFrame:
    kept = set(keep_columns)
    gone = set(post_origination_columns(loans.columns)) - kept
    return loans.select([c for c in loans.columns if c not in gone])


def select_origination_columns(loans: DataFrame, *, keep_columns: Iterable[str] = ("default_flag",)) -> DataFrame:
    """keep_columns and the origination columns that there are, in the policy's order."""
    there = set(loans.columns)
    return loans.select([c for c in dict.fromkeys((*keep_columns, *ORIGINATION_COLUMNS)) if c in there])
