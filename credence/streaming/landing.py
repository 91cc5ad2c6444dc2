"""A folder in which CSV files land: each is taken in once, what is no loan goes to quarantine."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions import missing_to_null
from credence.operators.evaluation import ClassificationMetrics
from credence.operators.schema import normalize_credit_schema
from credence.plans.job import run_baseline
from credence.sources.delimited import read_records
from credence.sources.loans import csv_columns

_FILES = "path string, modificationTime timestamp, length long, content binary"
#: Files that one batch takes in.
BATCH_FILES = 100
#: Files that are taken in at the same time: one alone has too few tasks for a cluster.
AT_ONCE = 8


def _digest(spark: SparkSession, path: str) -> str:
    """A name for the contents of a file: the number of its lines and two sums over their hashes. Line ends do not matter."""
    line = F.regexp_replace("value", r"\r$", "")
    found = spark.read.option("lineSep", "\n").text(path).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(line).cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(7), line)).alias("xor")).first()
    return f"{found['n']}_{int(found['sum'] or 0) % 2**64:016x}_{(found['xor'] or 0) % 2**64:016x}"


def _rejected(rows: DataFrame, reason: str, table: str, digest: str, mode: str = "overwrite") -> None:
    rows.select(F.lit(reason).alias("reason"), "record").write.mode(mode).parquet(f"{table}/rejects.parquet/digest={digest}")


def take_in(spark: SparkSession, path: str, table: str, *, column_aliases: Mapping[str, Any] | None = None, date_column: str = "issue_d", digest: str | None = None) -> None:
    """One file into `table`/loans.parquet and `table`/rejects.parquet.

    Both have a folder per contents, which is written whole: a file that is taken in again, after
    a failure or under another name, replaces its own rows. A header without a comma, and a quoted field
    that does not end, reject the file; a record whose number of fields is not the header's is
    rejected alone. `digest`: the name of its contents, if it is known.
    """
    digest = digest or _digest(spark, path)
    whole = spark.read.text(path).limit(1).select(F.col("value").alias("record"))
    try:
        header, records = read_records(spark, path)
    except ValueError:
        _rejected(whole, "file", table, digest)
        return
    if len(header) < 2:
        _rejected(whole, "header", table, digest)
        return
    fits = F.size("fields") == len(header)
    loans = records.filter(fits).select([missing_to_null(F.get("fields", F.lit(k))).alias(name) for k, name in enumerate(csv_columns(header))])
    normalize_credit_schema(loans, column_aliases=column_aliases, date_column=date_column).write.mode("overwrite").parquet(f"{table}/loans.parquet/digest={digest}")
    _rejected(records.filter(~fits).select(F.to_json("fields").alias("record")), "record", table, digest)


def take_in_folder(spark: SparkSession, folder: str, table: str, checkpoint: str, *, batch_files: int = BATCH_FILES, **options) -> None:
    """Every file of the folder and its subfolders that has not been taken in before; `checkpoint` remembers which."""
    def batch(files: DataFrame, _: int) -> None:
        paths = sorted(row["path"] for row in files.collect())  # names, as many as a batch has
        with ThreadPoolExecutor(AT_ONCE) as pool:
            # files of the same contents share a folder: one of them is written
            contents = dict(zip(pool.map(lambda path: _digest(spark, path), paths), paths))
            list(pool.map(lambda held: take_in(spark, held[1], table, digest=held[0], **options), contents.items()))

    landed = (spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
              .option("maxFilesPerTrigger", batch_files).load(folder).select("path"))
    query = landed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def refresh_from_folder(spark: SparkSession, folder: str, table: str, checkpoint: str, *, schema_config: Mapping[str, Any] | None = None,
                        date_column: str = "issue_d", **options) -> ClassificationMetrics:
    """Take in what has landed, then run the job on all loans that ever did."""
    take_in_folder(spark, folder, table, checkpoint, column_aliases=(schema_config or {}).get("column_aliases"), date_column=date_column)
    return run_baseline(spark, f"{table}/loans.parquet", schema_config=schema_config, date_column=date_column, merge_schema=True, **options)
