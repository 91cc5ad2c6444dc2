"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder below spark.checkpoint.dir.

    Where neither that setting nor a checkpoint folder is there and Spark runs on one machine
    (tests), a temporary folder is made and set as the checkpoint folder; on a cluster its
    executors would not find it, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise RuntimeError("On a cluster spark.checkpoint.dir must name a folder that driver and executors share.")
    return f"{base.rstrip('/')}/credence-{spark.sparkContext.applicationId}"
