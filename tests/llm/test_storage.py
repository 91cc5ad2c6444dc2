"""Shared storage."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from credence.llm import collocations, common, line_dedup, near_dedup


def test_tables_of_a_block_are_deleted(spark):
    rows = spark.range(5)
    outer = common.materialize(rows, "outer")
    with common.scratch(spark):
        inner = common.materialize(rows, "inner")
        path = inner.inputFiles()[0].removeprefix("file:")
        with common.scratch(spark):
            nested = common.materialize(inner, "nested").inputFiles()[0].removeprefix("file:")
        kept = common.materialize(inner, "kept", scoped=False)
        assert glob.glob(path) and not glob.glob(nested)
    assert not glob.glob(path) and kept.count() == 5 and outer.count() == 5
    common.drop_files(kept)
    assert outer.count() == 5


def test_a_cluster_needs_a_shared_folder():
    class Held:
        def isDefined(self):
            return False

    class Context:
        master = "spark://one:7077"
        applicationId = "x"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Held()})()})()

    session = type("Session", (), {"sparkContext": Context(), "conf": type("C", (), {"get": lambda self, *a: None})()})()
    with pytest.raises(RuntimeError):
        common.shared_dir(session)


def test_a_finished_query_leaves_its_result_only(spark, tmp_path):
    (spark.createDataFrame([(1, "a b c\nd e f"), (2, "a b c")], "doc_id bigint, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
     .write.parquet(str(tmp_path / "documents.parquet")))
    folder = common.shared_dir(spark).removeprefix("file://")
    for query, rows in ((near_dedup.op2_near_dedup, 2), (line_dedup.op3_line_dedup, 2), (collocations.op12_collocations, 0)):
        before = set(os.listdir(folder)) if os.path.exists(folder) else set()
        found = query(spark, str(tmp_path))
        assert {re.sub("-.*", "", x) for x in set(os.listdir(folder)) - before if not x.startswith(".")} == {"result"} and found.count() == rows
