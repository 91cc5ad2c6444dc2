"""Stages of a run that are made once: a rerun goes on at the first one that is missing."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def input_files(spark: SparkSession, path: str) -> list[list]:
    """Name, length and time of change of every file below a path, in order; empty if there is none."""
    at, files = _file_system(spark, path)
    if not files.exists(at):
        return []
    listed = files.listFiles(at, True)
    out = []
    while listed.hasNext():
        f = listed.next()
        out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(out)


class Stages:
    """The stages of one run below a folder.

    A stage's name carries a fingerprint of what the run reads, of its own parameters and of
    the stages before it, so a change of any of them makes it and its successors anew. It is
    done when its mark is there, which is written last and by a rename; what a lost driver has left
    of one without a mark is deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, inputs: Any):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fingerprint = hashlib.sha256(json.dumps(inputs, sort_keys=True, default=str).encode()).hexdigest()
        self.made: list[str] = []

    def stage(self, name: str, make: Callable[[str], None], parameters: Mapping[str, Any] | None = None) -> str:
        """The path of a stage; `make` writes it there unless it is done."""
        told = json.dumps([self.fingerprint, name, parameters or {}], sort_keys=True, default=str)
        self.fingerprint = hashlib.sha256(told.encode()).hexdigest()
        path = f"{self.folder}/{name}-{self.fingerprint[:20]}"
        mark, files = _file_system(self.spark, f"{path}.json")
        if not files.exists(mark):
            files.delete(_file_system(self.spark, path)[0], True)
            make(path)
            self.made.append(name)
            held = _file_system(self.spark, f"{path}.json.new")[0]
            out = files.create(held, True)
            out.write(bytearray(json.dumps({"stage": name, "fingerprint": self.fingerprint, "parameters": parameters or {}}, default=str).encode()))
            out.close()
            files.rename(held, mark)
        return path


def newest_stage(spark: SparkSession, folder: str, name: str) -> str:
    """The path of the stage of a name that was done last."""
    marks = [f for f in input_files(spark, folder) if f[0].rpartition("/")[2].startswith(f"{name}-") and f[0].endswith(".json")]
    if not marks:
        raise FileNotFoundError(f"There is no stage `{name}` in {folder}")
    return max(marks, key=lambda f: f[2])[0].removesuffix(".json")
