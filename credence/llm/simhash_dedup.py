"""SimHash near-dedup by pigeonhole blocks.

A document's fingerprint has a bit for each of 64: whether more than half of the hashes of
its shingles, repeats included, have it. Fingerprints link if they differ in at most
DISTANCE = 2 bits. They are split into four blocks; two that link agree in at least two
blocks, so they share one of the six buckets that two blocks name. A join on buckets,
with the distance as its condition, gives the links and nothing else.

Equal fingerprints are one class from the start, and buckets hold classes, so a group of
copies is one member. A bucket with more than BUCKET members is split by the same
principle once more: its free bits make four blocks again, of which two must agree, and so
on; after the third split eight bits are free, and no bucket can have more than BUCKET
members. Each member is thus compared with fewer than BUCKET others in a bucket, whatever
the data, and no bucket is collected anywhere. Components are found by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import documents, drop_files, materialize
from credence.llm.components import components

WIDTH = 3
SEED = 42
DISTANCE = 2
BLOCKS = 4
#: The most members of a bucket that are compared with each other, at least 2**8.
BUCKET = 256
_TOGETHER = 1 << 15


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The 64-bit fingerprint of a text with A-Z in lower case; 0 without words.

    With fewer words than `width` the whole sequence is the one shingle.
    """
    words = (text or b"").lower().split()  # of bytes: A-Z only, and x20, x09-x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.append(0, end[:-1] + 1)
    width = min(width, len(words))
    spans = zip(start[: len(words) - width + 1].tolist(), end[width - 1 :].tolist())
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _TOGETHER):
        part = hashes[at : at + _TOGETHER].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _masks(levels: int = 3) -> list[list[int]]:
    """For each level the bits that a bucket's members share, by the path of choices of two blocks."""
    def signed(bits) -> int:
        value = sum(1 << b for b in bits)
        return value - (1 << 64) if value >> 63 else value

    paths: list[tuple[tuple, tuple]] = [((), tuple(range(64)))]  # shared and free bits
    out = []
    for _ in range(levels):
        split = []
        for shared, free in paths:
            step = len(free) // BLOCKS
            blocks = [free[k * step : (k + 1) * step] for k in range(BLOCKS)]
            for pair in combinations(range(BLOCKS), BLOCKS - DISTANCE):
                own = tuple(b for k in pair for b in blocks[k])
                split.append((shared + own, tuple(b for b in free if b not in set(own))))
        paths = split
        out.append([signed(shared) for shared, _ in paths])
    return out


MASKS = _masks()
_CHOICES = len(MASKS[0])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "print"])

    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return materialize(texts.mapInArrow(made, "id bigint, print bigint").withColumn("row", F.monotonically_increasing_id()), "prints")


def _links(classes: DataFrame, bucket: int) -> DataFrame:
    """(a, b) of all classes (rep, print) whose prints differ in at most DISTANCE bits."""
    found = None
    rows = classes.select("rep", "print", F.lit(0).alias("path"))
    for masks in MASKS:
        table = F.array(*map(F.lit, masks))
        keyed = (rows.select("rep", "print", F.explode(F.sequence(F.col("path") * _CHOICES, F.col("path") * _CHOICES + _CHOICES - 1)).alias("path"))
                 .withColumn("shared", F.col("print").bitwiseAND(F.get(table, F.col("path")))))
        sizes = keyed.groupBy("path", "shared").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        # the key is turned so that Spark deals both sides and may split a hot bucket
        turned = sizes.select("path", F.bitwise_not("shared").alias("turned"), "size")
        members = materialize(keyed.withColumn("turned", F.bitwise_not("shared")).join(turned, ["path", "turned"]).drop("turned"), "members")
        small = members.filter(F.col("size") <= bucket)
        left = small.select("path", "shared", F.col("rep").alias("a"), F.col("print").alias("p"))
        right = small.select("path", "shared", F.col("rep").alias("b"), F.col("print").alias("q"))
        near = F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= DISTANCE
        linked = left.join(right, (left["path"] == right["path"]) & (left["shared"] == right["shared"]) & (F.col("a") < F.col("b")) & near).select("a", "b")
        linked = materialize(linked.distinct(), "links")
        found = linked if found is None else found.union(linked)
        rows = members.filter(F.col("size") > bucket).select("rep", "print", "path")
        if masks is MASKS[-1] or rows.isEmpty():
            return found.distinct()
    raise AssertionError("a bucket of the last level has at most 256 members")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: id, fingerprint (16 hexadecimal digits), component_id, kept.

    Null and empty texts and texts of white space have fingerprint zero and are linked like
    any other. Rows are told apart: those that repeat an id are classed by their own texts,
    and component_id is the least id of a component, null ids coming last. Of a component
    exactly one row is kept, of rows with its least id the one that was read first. Further
    columns are not read. An empty table gives an empty result.
    """
    if bucket < 1 << (64 >> len(MASKS)):
        raise ValueError("A bucket must take 256 members at least.")
    rows = _rows(docs, id_col, text_col)
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    classes = materialize(rows.groupBy("print").agg(F.min("row").alias("rep"), F.min(order).alias("least")), "classes")
    labels = components(_links(classes, bucket))
    joined = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    heads = joined.groupBy("component").agg(F.min("least").alias("head")).select(F.bitwise_not("component").alias("turned"), "head")
    named = joined.withColumn("turned", F.bitwise_not("component")).join(heads, "turned").select(F.bitwise_not("print").alias("turned"), "head")
    return (rows.withColumn("turned", F.bitwise_not("print")).join(named, "turned")
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("head.id").alias("component_id"),
                    (F.col("row") == F.col("head.row")).alias("kept")))


def op11_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))
