"""Random sharding as a two-pass external shuffle.

Pass one scatters the records over buckets by a seeded hash of their contents, as many
buckets as keep one bucket within memory whatever the input's size. Pass two shuffles each
bucket by Fisher-Yates with a generator seeded by the bucket's number, and writes it. The
records then have a place in one random order of all; place p goes to shard p mod n, slot
p div n, so shard sizes differ by one row at most and slots have no gaps. The order depends
on the seed and the records only, not on how the input was split into tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.llm.common import documents, materialize, text_column

BUCKET_BYTES = 32 << 20
BUCKET_ROWS = 100_000
#: Up to so many buckets their offsets, 16 bytes each, are sent to all tasks.
SENT_BUCKETS = 1 << 20
#: Most tasks of the second pass; beyond, a task has several buckets, one after another.
MOST_TASKS = 20_000


def fisher_yates(n: int, seed: tuple[int, ...]) -> list[int]:
    """A uniform permutation of range(n): swap each place with one at or before it."""
    order = list(range(n))
    draws = np.random.Generator(np.random.PCG64(seed)).integers(0, np.arange(1, n + 1)).tolist()
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return order


def _hashed(records: DataFrame) -> DataFrame:
    """record, and a hash of its contents."""
    columns = [F.col(f"`{f.name}`") for f in records.schema.fields]
    # maps have no hash; their text has
    values = [F.to_json(c) if isinstance(f.dataType, T.MapType) else c for c, f in zip(columns, records.schema.fields)]
    return records.select(F.struct(*columns).alias("record"), F.xxhash64(*values).alias("h"))


def _numbered(rows: DataFrame, many: int) -> DataFrame:
    """`rows` with `copy`, the number of a record among equal ones, where there are more than `many`, else 0.

    Equal records may change places, so any numbering gives the same shards. They are
    counted in blocks first, so that no task numbers a whole group.
    """
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > many)
    if often.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    often = materialize(often, "often")
    few = rows.join(often, "h", "left_anti").withColumn("copy", F.lit(0).cast("long"))
    block = F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / many)).cast("int")
    held = materialize(rows.withColumn("row", F.monotonically_increasing_id()).join(often, "h").withColumn("block", block).drop("n"), "copies")
    counts = held.groupBy("h", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("h", "block", (F.sum("n").over(Window.partitionBy("h").orderBy("block")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("h", "block").orderBy("row"))
    copies = held.withColumn("within", within).join(before, ["h", "block"])
    return few.unionByName(copies.select("record", "h", (F.col("within") + F.col("before")).alias("copy")))


def shard(records: DataFrame, n_shards: int, *, seed: int = 0, size: str | None = None,
          bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`records` as a struct column `record`, with shard and slot.

    `size` names a column of record sizes in bytes; without it only rows are counted. A
    bucket gets about bucket_bytes or bucket_rows, whichever is fewer rows. Records that
    repeat very often are numbered, so that they spread over the buckets as well.
    """
    totals = records.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(size) if size else F.lit(0)).alias("b")).first()
    buckets = max(1, -(-(totals["b"] or 0) // bucket_bytes), -(-totals["n"] // bucket_rows))
    rows = (_numbered(_hashed(records), max(1, bucket_rows // 100))
            .select("record", F.xxhash64(F.lit(seed), "h", "copy").alias("key"))
            .withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int")))
    # with the nullability of the records' own columns, as Arrow tables carry it
    schema = T.StructType([rows.schema["record"], T.StructField("bucket", T.IntegerType()), T.StructField("place", T.LongType())])

    def shuffled(bucket: pa.Table) -> pa.Table:
        by_key = np.argsort(bucket["key"].to_numpy(), kind="stable")
        order = by_key[fisher_yates(bucket.num_rows, (seed, bucket["bucket"][0].as_py()))]
        bucket = bucket.select(["record", "bucket"]).take(pa.array(order))
        return bucket.append_column("place", pa.array(np.arange(bucket.num_rows, dtype=np.int64)))

    placed = materialize(
        rows.repartitionById(min(buckets, MOST_TASKS), "bucket").groupBy("bucket").applyInArrow(shuffled, schema), "buckets")
    # running totals along the buckets: within spans of a thousand, and along the spans
    counts = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("span", F.floor(F.col("bucket") / 1000))
    spans = counts.groupBy("span").agg(F.sum("n").alias("n")).select("span", (F.sum("n").over(Window.orderBy("span")) - F.col("n")).alias("start"))
    offsets = (counts.withColumn("before", F.sum("n").over(Window.partitionBy("span").orderBy("bucket")) - F.col("n")).drop("n")
               .join(spans, "span").select("bucket", (F.col("before") + F.col("start")).alias("before")))
    place = F.col("place") + F.col("before")
    return placed.join(F.broadcast(offsets) if buckets <= SENT_BUCKETS else offsets, "bucket").select(
        "record", (place % n_shards).cast("int").alias("shard"), F.floor(place / n_shards).alias("slot"))


def write_shards(records: DataFrame, path: str, n_shards: int, **options) -> None:
    """Write every record into its shard's folder, in slot order within each file."""
    found = shard(records, n_shards, **options)
    (found.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot")
     .select("record.*", "shard", "slot").write.partitionBy("shard").parquet(path))


def op8_sharding(spark, sf_dir: str, n_shards: int = 40) -> DataFrame:
    size = (F.octet_length("text") + 16).cast("long")
    records = documents(spark, sf_dir).select("doc_id", text_column().alias("text")).withColumn("size", size)
    # size and checksum are those of the texts that come out
    return shard(records, n_shards, size="size").select("record.*", "shard", "slot").select(
        "doc_id", size.alias("size"), F.crc32(F.encode("text", "utf-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
