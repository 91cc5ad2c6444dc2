"""Reading raw loan tables and reports, writing reports."""

from credence.sources.config import config_argument, load_config
from credence.sources.loans import load_loans, read_raw_loans
from credence.sources.reports import read_curated, read_metrics, read_report_rows, write_curated, write_reports

__all__ = ["config_argument", "load_config", "load_loans", "read_curated", "read_metrics", "read_raw_loans", "read_report_rows", "write_curated", "write_reports"]
