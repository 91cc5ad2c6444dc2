"""Writing and reading back the reports of a run, and the curated feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALIBRATION_SCHEMA = "mean_predicted_probability double, observed_default_rate double"
THRESHOLD_SCHEMA = ("threshold double, true_positives long, false_positives long, true_negatives long, false_negatives long, "
                    "predicted_default_rate double, approval_rate double, total_cost double")


def write_reports(output_dir: str, model_type: str, *, metrics: DataFrame, calibration: DataFrame, thresholds: DataFrame) -> dict[str, str]:
    """One small file each: metrics as JSON, the calibration and threshold tables as CSV."""
    paths = {name: f"{output_dir.rstrip('/')}/metrics/{model_type}_{name}" for name in ("metrics.json", "calibration.csv", "threshold_costs.csv")}
    metrics.coalesce(1).write.mode("overwrite").json(paths["metrics.json"])
    calibration.coalesce(1).write.mode("overwrite").csv(paths["calibration.csv"], header=True)
    thresholds.coalesce(1).write.mode("overwrite").csv(paths["threshold_costs.csv"], header=True)
    return paths


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def read_report_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a report table that are finite numbers throughout."""
    rows = spark.read.csv(path, schema=schema, header=True)
    for name, kind in rows.dtypes:
        finite = F.col(name).isNotNull()
        if kind == "double":
            finite = finite & ~F.isnan(name) & (F.abs(name) < float("inf"))
        rows = rows.filter(finite)
    return rows


YEAR = "issue_year"


def write_curated(features: DataFrame, path: str, *, date_column: str = "issue_d", rows_per_file: int = 2_000_000, replace_years: bool = False) -> None:
    """Parquet by issue year, files sorted by date and with a bounded number of rows.

    Rows are rebalanced by year, so that files are few and of an even size: adaptive execution
    gives a year with most of the loans as many tasks as its size needs. With `replace_years`
    just the years of `features` are replaced, and other years' files stay as they are.
    """
    dated = features.withColumn(YEAR, F.year(date_column))
    rows = dated.hint("rebalance", YEAR).sortWithinPartitions(YEAR, date_column)
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if replace_years else "static")
     .option("maxRecordsPerFile", rows_per_file).partitionBy(YEAR).parquet(path))


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    """The curated table, its partitions as the column `issue_year`: a split by date should be given that column and takes it off."""
    return spark.read.parquet(path)
