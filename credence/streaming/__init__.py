"""Curation of loans that keep arriving: the same narrow plan on a stream."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from credence.operators.labels import closed_loans
from credence.operators.schema import normalize_credit_schema
from credence.plans.job import curate


def curate_stream(raw: DataFrame, *, column_aliases: Mapping[str, Any] | None = None, date_column: str = "issue_d") -> DataFrame:
    """Every step of curation is row by row, so it takes a streaming frame as it is."""
    return curate(closed_loans(normalize_credit_schema(raw, column_aliases=column_aliases, date_column=date_column)))
