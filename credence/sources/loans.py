"""Reading raw loan tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions import missing_to_null
from credence.operators.labels import CLOSED_STATUSES, closed_loans
from credence.operators.schema import normalize_credit_schema
from credence.sources.delimited import read_records


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def csv_columns(header: list[str]) -> list[str]:
    """Column names of a header: those after the first of a name get a suffix."""
    seen: dict[str, int] = {}
    out = []
    for name in header:
        seen[name] = seen.get(name, -1) + 1
        out.append(name + (f".{seen[name]}" if seen[name] else ""))
    return out


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns as strings, stand-ins for missing values as null.

    Quoted fields may have line breaks, doubled quotes and backslashes, and a file is read by
    several tasks all the same. The header is taken as it is written. A record with fewer
    fields than the header has nulls for the others; further fields are dropped.
    """
    header, records = read_records(spark, path)
    if not header:
        raise ValueError(f"The file has no header: {path}")
    return records.select([missing_to_null(F.get("fields", F.lit(k))).alias(name) for k, name in enumerate(csv_columns(header))])


def read_raw_loans(spark: SparkSession, path: str, *, merge_schema: bool = False) -> DataFrame:
    """By suffix, case aside: .csv, or .parquet / .pq. `merge_schema`: Parquet files may differ in their columns."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"There is no input at {path}")
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix == "csv":
        return read_csv(spark, path)
    if suffix in ("parquet", "pq"):
        return spark.read.option("mergeSchema", merge_schema).parquet(path)
    raise ValueError("A raw loan table must end in .csv, .parquet or .pq.")


def load_loans(spark: SparkSession, path: str, *, closed_statuses: Iterable[str] = CLOSED_STATUSES,
               column_aliases: Mapping[str, Any] | None = None, date_column: str = "issue_d", merge_schema: bool = False) -> DataFrame:
    """Closed loans under canonical names with parsed issue dates."""
    raw = read_raw_loans(spark, path, merge_schema=merge_schema)
    return closed_loans(normalize_credit_schema(raw, column_aliases=column_aliases, date_column=date_column),
                        closed_statuses=closed_statuses)
