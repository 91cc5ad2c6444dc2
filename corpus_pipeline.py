"""The corpus pipeline: quality rules, exact dedup, near-dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and
returns a DataFrame; `run` writes each one's result to the shared folder as Parquet and
hands the reread table on. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from credence.llm import exact_dedup, near_dedup, packing, quality_rules, secret_scan
from credence.llm.common import documents, drop_files, materialize, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; labels, where there are any, say what the soft rules are worth."""
    return quality_rules.quality_filter(docs, labels=quality_rules.labels_of(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest doc_id stays."""
    return near_dedup.near_dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by their kind in brackets."""
    return secret_scan.redact(docs, count_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token sequences in windows of 2048: one row per piece, with its ids."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("secret_scan", secrets),
    ("best_fit_packing", pack),
]

#: Near-dedup's components, automata and packing have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage needed for itself, and the table before it, are deleted after it."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", scoped=False)
        if before is not None:
            drop_files(before)
        before = docs
    return docs
