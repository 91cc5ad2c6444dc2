"""One-hot slots from a dictionary that is a table.

Each category of a column gets a dense number in ascending order: distinct values are dealt
into ranges of their order, numbered within their range, and the sizes of the ranges before
are added. The dictionary stays a table, on disk; rows get their numbers by a join with it,
which is a broadcast only if the table's size has been checked to allow it. Neither the driver
nor a model holds the categories themselves, and no metadata names them. A value that training
has not seen finds no number and has no slot.
"""

from __future__ import annotations

import uuid
import warnings
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.sources.storage import shared_folder

#: Bytes of a column's categories up to which they are sent to all tasks.
SENT_BYTES = 32 << 20
#: A column with more categories is warned about: each is a slot of the model.
MANY_CATEGORIES = 1000


@dataclass(frozen=True)
class Dictionary:
    """A table (k, value, number) at `path`, and of each column k its number of values and their bytes."""

    path: str
    sizes: list[int]
    bytes: list[int]


def build_dictionary(rows: DataFrame, values: list[Column], names: list[str] | None = None, ranges: int | None = None) -> Dictionary:
    """Numbers from 0 for the distinct non-null values of each column (a string), ascending."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/categories-{uuid.uuid4().hex}"
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("value")) for k, v in enumerate(values)])).alias("s")
    distinct = rows.select(every).select("s.*").filter("value IS NOT NULL").distinct()
    ranged = distinct.repartitionByRange(*([ranges] if ranges else []), "k", "value").withColumn("range", F.spark_partition_id())
    ranged.write.parquet(f"{folder}/ranges")  # ranges stay as they were dealt
    ranged = spark.read.parquet(f"{folder}/ranges")
    counts = ranged.groupBy("k", "range").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 16).alias("bytes"))
    before = Window.partitionBy("k").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range and column
    offsets = counts.select("k", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("k", "range").orderBy("value"))
    numbered = ranged.join(offsets, ["k", "range"]).select("k", "value", (F.col("before") + within - 1).cast("int").alias("number"))
    numbered.write.parquet(f"{folder}/numbers")
    found = {r["k"]: r for r in counts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect()}
    sizes = [found[k]["n"] if k in found else 0 for k in range(len(values))]
    for k, n in enumerate(sizes):
        if n > MANY_CATEGORIES:
            warnings.warn(f"Column `{names[k] if names else k}` has {n} categories, each a slot of the model; is it meant to be numeric or left out?", stacklevel=2)
    return Dictionary(f"{folder}/numbers", sizes, [found[k]["bytes"] if k in found else 0 for k in range(len(values))])


def _numbered(rows: DataFrame, held: Dictionary, columns: list[str], sent_bytes: int) -> DataFrame:
    """`rows` with the number of each of the columns' values as _i0, _i1, ...; null for one that is not there."""
    table = rows.sparkSession.read.parquet(held.path)
    for k, column in enumerate(columns):
        own = table.filter(F.col("k") == k).select(F.col("value").alias(f"_v{k}"), F.col("number").alias(f"_i{k}"))
        own = F.broadcast(own) if held.bytes[k] <= sent_bytes else own
        rows = rows.join(own, F.col(f"`{column}`") == F.col(f"_v{k}"), "left").drop(f"_v{k}")
    return rows


def _sparse(width: int, offsets: list[int]):
    """A function of numeric columns and numbers of categories to one sparse vector, for batches."""
    size = width + (offsets[-1] if offsets else 0)

    @F.arrow_udf(VectorUDT())
    def assembled(*columns: pa.Array) -> pa.Array:
        n = len(columns[0])
        places, values = np.empty((n, len(columns)), np.int32), np.ones((n, len(columns)))
        there = np.ones((n, len(columns)), bool)
        for k, column in enumerate(columns):
            if k < width:
                places[:, k], values[:, k] = k, column.to_numpy(zero_copy_only=False)
            else:
                there[:, k] = ~np.asarray(column.is_null())
                places[:, k] = column.fill_null(0).to_numpy(zero_copy_only=False) + (width + offsets[k - width - 1] if k > width else width)
        ends = np.append(0, np.cumsum(there.sum(axis=1))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[there])) for x in (places, values)]
        return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *lists], names=["type", "size", "indices", "values"])

    return assembled


class CategoryEncoder(Transformer, MLReadable, MLWritable):
    """Numeric columns, then a slot for each category, as one sparse vector; it is saved with its dictionary."""

    numericCols: Param[list[str]] = Param(Params._dummy(), "numericCols", "columns that are slots themselves", TypeConverters.toListString)
    categoryCols: Param[list[str]] = Param(Params._dummy(), "categoryCols", "columns with a slot per category", TypeConverters.toListString)
    sizes: Param[list[int]] = Param(Params._dummy(), "sizes", "categories of each column", TypeConverters.toListInt)
    bytes: Param[list[int]] = Param(Params._dummy(), "bytes", "bytes of each column's categories", TypeConverters.toListInt)
    dictionary: Param[str] = Param(Params._dummy(), "dictionary", "where the dictionary is", TypeConverters.toString)
    outputCol: Param[str] = Param(Params._dummy(), "outputCol", "the vector", TypeConverters.toString)
    sentBytes: Param[int] = Param(Params._dummy(), "sentBytes", "bytes of categories up to which they are sent to all tasks", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, numericCols: Any = None, categoryCols: Any = None, sizes: Any = None, bytes: Any = None, dictionary: Any = None, outputCol: Any = None, sentBytes: Any = None):
        super().__init__()
        self._setDefault(sentBytes=SENT_BYTES, sizes=[], bytes=[], numericCols=[], categoryCols=[], dictionary="", outputCol="features")
        self._set(**self._input_kwargs)

    def numbered(self, dataset: DataFrame) -> tuple[DataFrame, list[str]]:
        """Rows with the number of each category within its column, null for an unseen one, and these columns' names."""
        get = self.getOrDefault
        categories = get(self.categoryCols)
        held = Dictionary(get(self.dictionary), get(self.sizes), get(self.bytes))
        return _numbered(dataset, held, categories, get(self.sentBytes)) if categories else dataset, [f"_i{k}" for k in range(len(categories))]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        numeric = self.getOrDefault(self.numericCols)
        rows, numbers = self.numbered(dataset)
        offsets = np.cumsum(self.getOrDefault(self.sizes)).tolist()
        inputs = [F.col(f"`{c}`") for c in (*numeric, *numbers)]
        return rows.withColumn(self.getOrDefault(self.outputCol), _sparse(len(numeric), offsets)(*inputs)).drop(*numbers)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, encoder: CategoryEncoder):
        super().__init__()
        self.encoder = encoder

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.encoder, path, self.sparkSession)
        if self.encoder.getOrDefault("categoryCols"):
            self.sparkSession.read.parquet(self.encoder.getOrDefault("dictionary")).write.parquet(f"{path}/dictionary")


class _Reader(MLReader):
    def load(self, path: str) -> CategoryEncoder:
        encoder = CategoryEncoder()
        DefaultParamsReader.getAndSetParams(encoder, metadata := DefaultParamsReader.loadMetadata(path, self.sparkSession))
        encoder._resetUid(metadata["uid"])
        return encoder._set(dictionary=f"{path}/dictionary")
