"""Numbers and dates out of untidy strings, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cell contents of a CSV file that mean "missing".
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_INFINITE = r"(?i)^[+-]?inf(inity)?$"

#: Tried in turn after ISO dates; month first where day and month could be swapped.
DATE_FORMATS = ("MMM-yyyy", "MMMM-yyyy", "MMM yyyy", "MMMM yyyy", "MMM-yy", "M/d/yyyy", "d/M/yyyy", "yyyyMMdd")


def missing_to_null(value: Column) -> Column:
    """Null for a string that stands for a missing value."""
    return F.when(~F.trim(value).isin(*MISSING_TOKENS), value)


def _number(text: Column) -> Column:
    infinite = F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(text.rlike(_NUMBER), text.try_cast("double")).when(text.rlike(_INFINITE), infinite)


def coerce_numeric(value: Column) -> Column:
    """A double: percent signs removed, trimmed, null where what is left is no number.

    Numbers with type letters (12d), digit groups (1,000) and NaN give null.
    """
    return _number(F.trim(F.replace(value.cast("string"), F.lit("%"), F.lit(""))))


def coerced(rows: DataFrame, name: str) -> Column:
    """`coerce_numeric` of a column; one of numbers is not written as text and read again."""
    value, kind = F.col(f"`{name}`"), rows.schema[name].dataType
    if isinstance(kind, T.DoubleType):
        return F.when(~F.isnan(value), value)
    if isinstance(kind, (T.IntegralType, T.DecimalType)):  # a float's text is another number than the float
        return value.cast("double")
    return coerce_numeric(value)


def parses_as_number(value: Column) -> Column:
    """Whether a non-null value is a number as it stands, percent signs not removed."""
    text = F.trim(value.cast("string"))
    return text.rlike(_NUMBER) | text.rlike(_INFINITE)


def parse_issue_date(value: Column) -> Column:
    """A timestamp_ntz from mixed formats, null where none fits; a time of day is kept."""
    def parsed(text: Column) -> Column:
        # a bare number of up to five digits is no date, though a cast would take four as a year
        iso = F.when(text.rlike(r"^\d{4}-\d{1,2}(-\d{1,2})?([ T].*)?$") | text.rlike(r"^\d{4}$"), text.try_cast("timestamp_ntz"))
        tried = [F.try_to_timestamp(text, F.lit(f)).try_cast("timestamp_ntz") for f in DATE_FORMATS]
        return F.coalesce(iso, *tried)

    # a lambda's variable: what the text is made of is computed once and not for each try
    return F.get(F.transform(F.array(F.trim(value.cast("string"))), parsed), F.lit(0))
