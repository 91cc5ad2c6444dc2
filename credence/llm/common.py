"""What the operators of this subpackage share: storage, text bytes and word hashes.

Conventions that hold for every operator here unless its docstring says otherwise:

* a null text counts as the empty text, a null id stays null;
* only the id and text columns that are named are read, so further columns, whatever
  their names, do not matter;
* repeated rows are separate rows: each gets its own result row;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.sources.storage import shared_folder

#: Odd multiplier of the polynomial word hash and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_Q = np.uint64(0xD1B54A32D192ED03)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_scope: ContextVar[str] = ContextVar("scope", default="")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; an error on a cluster without it."""
    return shared_folder(spark)


def materialize(df: DataFrame, label: str, scoped: bool = True) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation, and values
    such as generated row ids stay as they were written. Within `scratch` the table goes
    with its block, unless it is not `scoped`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}{_scope.get() if scoped else ''}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that are materialized in the block when it ends; nothing may read them then."""
    name = f"{_scope.get()}/scratch-{uuid.uuid4().hex}"
    held = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(held)
        _delete(spark, shared_dir(spark) + name)


def finished(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose result is written, after which the tables that it needed on the way are deleted."""
    @wraps(make)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch(spark):
            return materialize(make(spark, sf_dir), "result", scoped=False)

    return query


def drop_files(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"/credence-{spark.sparkContext.applicationId}/" in parent:
            _delete(spark, parent)


def text_column(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


# ---------------------------------------------------------------- word hashing

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n, grown as needed and kept per process."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(size, base & (2**64 - 1), np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all their bits depend on all of the input."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def white_space(buf: np.ndarray) -> np.ndarray:
    """Which bytes are one of x20, x09-x0D."""
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each run of bytes that are not white space."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~white_space(buf)
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A quick 64-bit hash of every span; the same bytes give the same hash anywhere. For slots and keys of
    what is compared later; two different long words may be built to have one hash."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) * _Q))


#: Key of the words' digests: sixteen characters.
_KEY = "credence-corpora"


def word_digests(words: list[bytes]) -> np.ndarray:
    """64 bits of SipHash of each word, without structure that a text could be built to exploit.

    Where a hash decides, use these: sums of powers modulo 2**64, as in `word_hashes`, are equal
    for some pairs of long words whatever the multiplier.
    """
    if not words:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, object), hash_key=_KEY, categorize=False)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of `width` words, by its first word; order matters."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = mix(total * _Q + words[k : k + n])
    return total


def text_digest(text: bytes) -> tuple[int, int]:
    """128 bits of BLAKE2 as two signed numbers."""
    digest = hashlib.blake2b(text, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def utf8(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def clear_shared(spark: SparkSession) -> None:
    """Delete all tables that this application has materialized; nothing may read them any more."""
    _delete(spark, shared_dir(spark))
