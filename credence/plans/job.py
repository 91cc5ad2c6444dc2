"""Whole jobs: curation, training with all reports, evaluation of a scored table."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from credence.operators.calibration import calibration_curve
from credence.operators.evaluation import (ClassificationMetrics, CostMatrix, metrics_report, score_counts, selected_threshold,
                                           threshold_costs)
from credence.operators.features import feature_matrix
from credence.operators.labels import default_target, with_target
from credence.operators.models import TRAINERS, score, train_model
from credence.operators.policy import exclude_leaky_columns, select_origination_columns
from credence.operators.split import TimeSplit, time_split
from credence.plans.stages import Stages, input_files
from credence.sources.config import config_argument
from credence.sources.loans import load_loans
from credence.sources.reports import YEAR, read_curated, write_curated, write_reports


def curate(loans: DataFrame) -> DataFrame:
    """Labelled, leak-free features of closed loans: one narrow plan, no shuffle."""
    return (loans.transform(default_target).transform(with_target).transform(exclude_leaky_columns)
            .transform(select_origination_columns).transform(feature_matrix))


def run_baseline(spark: SparkSession, raw_data_path: str, *, train_end_date: str, test_start_date: str, date_column: str = "issue_d",
                 output_dir: str = "reports", model_type: str = "logistic_regression", model_config: Mapping[str, Any] | None = None,
                 schema_config: Mapping[str, Any] | None = None, cost_matrix: CostMatrix | None = None, merge_schema: bool = False) -> ClassificationMetrics:
    """Load, curate, split by date, fit, score the later loans, write model and reports.

    Curated loans, model and scores are stages below `output_dir`/stages: a run that is started again,
    with the same input files and parameters, takes what is done and goes on from there. What
    a stage reads is on disk, so a lost executor costs a re-read.
    """
    if schema_config is not None and not isinstance(schema_config, Mapping):
        raise ValueError("Schema configuration must be a mapping.")
    if model_type not in TRAINERS:
        raise ValueError(f"Unknown model type; there are {sorted(TRAINERS)}.")
    cost_matrix = cost_matrix or CostMatrix()
    output = output_dir.rstrip("/")
    aliases = (schema_config or {}).get("column_aliases")
    files = input_files(spark, raw_data_path)
    if not files:
        raise FileNotFoundError(f"There is no input at {raw_data_path}")
    stages = Stages(spark, f"{output}/stages", files)

    def curated_stage(path: str) -> None:
        curated = curate(load_loans(spark, raw_data_path, column_aliases=aliases, date_column=date_column, merge_schema=merge_schema))
        if date_column not in curated.columns:
            raise KeyError(f"There is no date column `{date_column}`.")
        write_curated(curated, path, date_column=date_column)

    curated = stages.stage("curated", curated_stage, {"aliases": aliases, "date_column": date_column, "merge_schema": merge_schema})
    dates = {"date_column": date_column, "train_end_date": train_end_date, "test_start_date": test_start_date}

    def split(check: bool) -> TimeSplit:
        return time_split(read_curated(spark, curated), **dates, year_column=YEAR, check=check)

    fitted = stages.stage("model", lambda path: train_model(split(True).train, model_type, config=model_config, stored=True).write().overwrite().save(path),
                          {**dates, "model_type": model_type, "config": model_config})
    model = PipelineModel.load(fitted)
    model.write().overwrite().save(f"{output}/models/{model_type}")
    scores = stages.stage("scores", lambda path: score(model, split(False).test).select(
        F.col("default_flag").alias("label"), F.col("default_probability").alias("score")).write.parquet(path))
    scored = spark.read.parquet(scores)
    counts = score_counts(scored).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        costs = threshold_costs(scored, cost_matrix=cost_matrix)
        # a report of one row
        row = metrics_report(counts, selected_threshold(costs)).first().asDict()
        payload = row | {"false_negative_cost": float(cost_matrix.false_negative_cost), "false_positive_cost": float(cost_matrix.false_positive_cost), "model_type": model_type}
        metrics = spark.createDataFrame([tuple(payload.values())], list(payload))
        write_reports(output, model_type, metrics=metrics, calibration=calibration_curve(counts), thresholds=costs)
    finally:
        counts.unpersist()
    return ClassificationMetrics(**{k: row[k] for k in ClassificationMetrics.__dataclass_fields__})


def refresh_reports(spark: SparkSession, csv_path: str, **options) -> dict[str, float]:
    """Run a landed CSV file with costs 5 and 1; its header must have more than one column."""
    header = spark.read.text(csv_path).limit(1).collect()
    if not header or "," not in header[0]["value"]:
        raise ValueError("The file must be a CSV file with a header.")
    found = run_baseline(spark, csv_path, cost_matrix=CostMatrix(5.0, 1.0), **options)
    return {"auc_roc": found.auc_roc, "average_precision": found.average_precision, "ks_statistic": found.ks_statistic}


def parse_args(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Train and evaluate a default model on a raw loan table.")
    parser.add_argument("raw_data_path")
    parser.add_argument("--train-end-date", required=True)
    parser.add_argument("--test-start-date", required=True)
    parser.add_argument("--date-column", default="issue_d")
    parser.add_argument("--output-dir", default="reports")
    parser.add_argument("--model-type", default="logistic_regression", choices=sorted(TRAINERS))
    parser.add_argument("--model-config", type=config_argument, default=None, help="model parameters: a JSON object, or a JSON or YAML file; of a file with a block per model that model's")
    parser.add_argument("--schema-config", type=config_argument, default=None, help="a JSON object with column_aliases, or a JSON or YAML file")
    parser.add_argument("--false-negative-cost", type=float, default=5.0)
    parser.add_argument("--false-positive-cost", type=float, default=1.0)
    args = parser.parse_args(argv)
    if args.model_config and args.model_type in args.model_config:
        args.model_config = args.model_config[args.model_type]
    return args


def main(argv: Sequence[str] | None = None) -> int:
    try:
        args = vars(parse_args(argv))
    except (FileNotFoundError, ValueError) as error:
        print(f"Pipeline failed: {error}", file=sys.stderr)
        return 1
    costs = CostMatrix(args.pop("false_negative_cost"), args.pop("false_positive_cost"))
    spark = SparkSession.builder.appName("credence").getOrCreate()
    try:
        found = run_baseline(spark, args.pop("raw_data_path"), cost_matrix=costs, **args)
    except (FileNotFoundError, KeyError, ValueError) as error:
        print(f"Pipeline failed: {error.args[0] if error.args else error}", file=sys.stderr)
        return 1
    print(json.dumps(found.as_dict(), indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
