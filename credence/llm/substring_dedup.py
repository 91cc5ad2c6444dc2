"""Dedup of repeated byte strings by suffix order, built column by column.

A byte goes if some string of LENGTH bytes covers it that also starts earlier, in a
document of smaller id or earlier in the same one.

1. Runs. Of the K-byte strings within a window of LENGTH bytes the one of least hash is the
   window's anchor; neighbouring windows share it, so a text falls into runs of windows of
   one anchor, about one run for 40 bytes. Equal windows have equal anchors in equal
   places. Runs whose anchor occurs once in the corpus cannot repeat and drop out.
2. Whole runs that are equal, by 128 bits of hash, repeat from the earliest of them on. What
   is left open are anchors whose runs differ: the edges of repeated passages.
3. The bytes of the open runs, the earliest of each kind, are a collection of short
   strings, set so that their anchors are in one column. Their suffix order is built with
   all strings at once, from the last column to the first: each round inserts one symbol
   per string. The symbols in the order so far are the column's Burrows-Wheeler transform;
   counting them gives the next order, and the common prefixes of neighbours are updated
   along with it. Neighbours that share LENGTH bytes are the same window, and all but the
   earliest repeat. As equal windows start in one column, only suffixes of one column
   need an order among them, and a round costs one step a string. An anchor with
   more strings than a bucket has (a passage that a great number of documents share has an
   edge of its own in each) is not collected: its windows are compared by 128 bits of hash,
   in a join.
4. The repeated intervals of each document are joined back to its text.

The construction reads the order and writes the next one from front to back in each round,
as it would files; a bucket of strings is sized to fit in memory, so they stay arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import _P, _Q, _power_tables, documents, materialize, mix

LENGTH = 100
K = 24
#: Longest stretch of a text whose runs are taken at once; stretches overlap by LENGTH - 1.
STRETCH = 4 << 20
#: Strings of one bucket of the construction, about.
BUCKET_STRINGS = 20_000
#: Most tasks of the construction; beyond, a task has several buckets, one after another.
MOST_TASKS = 20_000
#: Farthest that a window begins before its anchor.
LEFT = LENGTH - K
_PLACE = np.uint64((1 << 23) - 1)


def runs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run: anchor hash, hash of anchor, place and bytes, first window, windows after it, anchor's offset."""
    parts = []
    for base in range(0, max(len(text) - LENGTH + 1, 0), STRETCH):
        buf = np.frombuffer(text, np.uint8, min(STRETCH + LENGTH - 1, len(text) - base), base)
        n, width = len(buf), LENGTH - K + 1
        power, inverse = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        grams = mix((sums[K:] - sums[:-K]) * inverse[: n - K + 1])
        # high bits of the hash, then the place: the least is the leftmost of least hash
        least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        covered = 1
        while covered * 2 <= width:
            least = np.minimum(least[:-covered], least[covered:])
            covered *= 2
        if covered < width:
            least = np.minimum(least[: len(least) - (width - covered)], least[width - covered :])
        anchor = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        last = np.append(first[1:], len(anchor)) - 1
        at = anchor[first]
        a = grams[at]
        span = mix((sums[last + LENGTH] - sums[first]) * inverse[first])
        c = mix(span + a * _Q + ((last - first) * 128 + at - first).astype(np.uint64) * np.uint64(_P))
        parts.append((a, c, first + base, last - first, at - first))
    if not parts:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts))


def pack_place(first: np.ndarray, more: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return (first << 14) | (more << 7) | offset


def unpack_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, how many follow it, and how far its start is before the anchor."""
    return place >> 14, (place >> 7) & 127, place & 127


# ---------------------------------------------------------------- suffix order, column by column


def columns(strings: list[bytes], offset: np.ndarray) -> np.ndarray:
    """The strings as rows, their anchors in one column; 0 where a string has no byte."""
    lengths = np.array([len(x) for x in strings], np.int64)
    flat = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
    begin = np.cumsum(lengths) - lengths
    table = np.zeros((LEFT + LENGTH, len(strings)), np.uint16)
    row = np.repeat(np.arange(len(strings)), lengths)
    table[np.arange(len(flat)) - begin[row] + LEFT - offset[row], row] = flat
    return table


def insert_column(order: np.ndarray, common: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes with one more symbol to the left, and their common prefixes.

    `symbols` in the old order are the column's transform; a stable count by symbol gives the
    new places. Two neighbours that begin with the same symbol share one more than the least
    between their old places.
    """
    transform = symbols[order]
    moved = np.argsort(transform, kind="stable")
    same = np.flatnonzero(transform[moved[1:]] == transform[moved[:-1]]) + 1
    new = np.zeros(len(order), np.int32)
    if len(same):
        between = np.stack([moved[same - 1] + 1, moved[same] + 1], axis=1).ravel()
        new[same] = 1 + np.minimum.reduceat(np.append(common, 0), between)[::2]
    return order[moved], new


def repeated_windows(strings: list[bytes], rank: np.ndarray, first: np.ndarray, more: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, window's start in it) of the windows that occur earlier.

    rank: order of the strings' documents; first: where a string starts in its document;
    more: how many windows follow its first; offset: the anchor's place in it. Equal windows
    have equal anchors in equal places, so they start in one column.
    """
    table = columns(strings, offset)
    order, common = np.arange(len(strings)), np.zeros(len(strings), np.int32)
    who, where = [], []
    for column in range(len(table) - 1, -1, -1):
        order, common = insert_column(order, common, table[column])
        if column > LEFT:
            continue
        start = column - LEFT + offset  # of a window that begins in this column, by string
        whole = ((start >= 0) & (start <= more))[order]
        head = np.flatnonzero(whole)
        if len(head) < 2:
            continue
        # up to the last whole window: what is sorted after it does not part it from the one before
        since = np.minimum.reduceat(common[: head[-1] + 1], np.append(0, head[:-1] + 1))
        owner = order[head]
        groups = np.flatnonzero(np.append(True, since[1:] < LENGTH))
        place = (rank[owner].astype(np.int64) << 40) | (first[owner] + start[owner])
        later = place > np.repeat(np.minimum.reduceat(place, groups), np.diff(np.append(groups, len(place))))
        who.append(owner[later])
        where.append(start[owner[later]])
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(who), np.concatenate(where)


# ---------------------------------------------------------------- Spark


def _ordered(docs: DataFrame) -> DataFrame:
    """(name, id, text) of (name, text): `id` orders the documents and is not repeated by other texts.

    Ids do so themselves unless some repeat; then each id and text gets its place in their order.
    """
    if docs.filter("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return docs.withColumn("id", F.col("name"))
    hashed = docs.withColumn("h", F.xxhash64("text"))
    # ascending along the sorted partitions
    places = materialize(hashed.filter("name IS NOT NULL").select(F.col("name").alias("own"), F.col("h").alias("own_h")).distinct()
                         .orderBy("own", "own_h").withColumn("id", F.monotonically_increasing_id()), "places")
    return hashed.join(places, (F.col("name") == F.col("own")) & (F.col("h") == F.col("own_h")), "left").select("name", "id", "text")


def _runs(docs: DataFrame) -> DataFrame:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, columns = [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1)):
                    a, c, first, more, offset = runs(text.as_py())
                    ids.append(np.full(len(a), key if key is not None else 0, np.int64))
                    columns.append((a.view(np.int64), c.view(np.int64), pack_place(first, more, offset)))
                a, c, place = (np.concatenate(x) for x in zip(*columns))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(np.concatenate(ids)), pa.array(place)], names=["a", "c", "id", "place"])

    return docs.filter("id IS NOT NULL").select("id", "text").mapInArrow(found, "a bigint, c bigint, id bigint, place bigint")


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed, for the shuffles that have to carry them."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([squeeze(t.as_py()) for t in batch.column(2)], pa.binary())],
                                             names=["name", "id", "packed"])

    return docs.select("name", "id", "text").mapInArrow(packed, "name bigint, id bigint, packed binary")


def _strings(open_runs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, id, first, more, offset, string) of the open runs; a string ends LENGTH bytes after
    its anchor's start, or with the text."""
    wanted = open_runs.groupBy("id").agg(F.collect_list(F.struct("a", "place")).alias("open"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = []
                part = batch.slice(at, 200)
                for key, packed, wanted in zip(part.column(0).to_pylist(), part.column(1), part.column(2)):
                    text = unpack(packed.as_py())
                    own = wanted.values
                    places = [x.tolist() for x in unpack_place(own.field("place").to_numpy())]
                    rows += [(a, key, f, m, o, text[f : f + o + LENGTH]) for a, f, m, o in zip(own.field("a").to_pylist(), *places)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.binary()])],
                                                     names=["a", "id", "first", "more", "offset", "string"])

    return _packed(docs).join(wanted, "id").select("id", "packed", "open").mapInArrow(cut, "a bigint, id bigint, first bigint, more bigint, offset bigint, string binary")


def _hot_windows(strings: DataFrame) -> DataFrame:
    """(id, start, end) of the windows of `strings` that occur earlier, by 128 bits of hash."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, starts, digests = [], [], []
                for key, first, more, string in zip(*(part.column(k).to_pylist() for k in range(4))):
                    ids.append(np.full(more + 1, key))
                    starts.append(np.arange(first, first + more + 1))
                    digests += [xxhash.xxh3_128_digest(string[k : k + LENGTH]) for k in range(more + 1)]
                own = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(own[:, 0].copy()), pa.array(own[:, 1].copy()), pa.array(np.concatenate(ids)), pa.array(np.concatenate(starts))],
                                                 names=["w1", "w2", "id", "start"])

    windows = materialize(strings.select("id", "first", "more", "string").mapInArrow(hashed, "w1 bigint, w2 bigint, id bigint, start bigint"), "windows")
    place = F.struct("id", "start")
    firsts = windows.groupBy("w1", "w2").agg(F.min(place).alias("earliest"), F.max(place).alias("last")).filter("earliest < last")
    return (windows.withColumn("key", F.bitwise_not("w1")).join(firsts.select(F.bitwise_not("w1").alias("key"), "w2", "earliest"), ["key", "w2"])
            .filter(place > F.col("earliest")).select("id", "start", (F.col("start") + LENGTH).alias("end")))


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal ones."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    head = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
    return starts[head], np.append(ends[head[1:] - 1], ends[-1])


def repeated_intervals(docs: DataFrame, bucket_strings: int = BUCKET_STRINGS) -> DataFrame:
    """(id, start, end) of repeated bytes of (name, id, text as binary); intervals may overlap."""
    found = _runs(docs)
    short = F.shiftright("a", 24)
    again = found.groupBy(short.alias("s")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.bitwise_not("s").alias("key"))
    repeated = materialize(found.withColumn("key", F.bitwise_not(short)).join(again, "key").drop("key"), "runs")
    place = F.struct("id", "place")
    firsts = materialize(repeated.groupBy("a", "c").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    whole = (repeated.withColumn("key", F.bitwise_not("c"))
             .join(firsts.filter("n > 1").select(F.bitwise_not("c").alias("key"), "a", "first"), ["key", "a"])
             .filter(F.struct("id", "place") > F.col("first")).select("id", "place"))
    window = F.shiftright("place", 14)
    whole = whole.select("id", window.alias("start"), (window + F.shiftright("place", 7).bitwiseAND(F.lit(127)) + LENGTH).alias("end"))
    kinds = firsts.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select(F.bitwise_not("a").alias("key"))
    open_runs = firsts.withColumn("key", F.bitwise_not("a")).join(kinds, "key").select("a", "first.*")
    strings = materialize(_strings(open_runs, docs), "strings")
    often = strings.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket_strings).select(F.bitwise_not("a").alias("key"))
    turned = strings.withColumn("key", F.bitwise_not("a"))
    buckets = max(1, -(-strings.count() // bucket_strings))

    def resolve(table: pa.Table) -> pa.Table:
        ids, first = table["id"].to_numpy(), table["first"].to_numpy()
        _, rank = np.unique(ids, return_inverse=True)
        who, start = repeated_windows(table["string"].to_pylist(), rank, first, table["more"].to_numpy(), table["offset"].to_numpy())
        order = np.lexsort((start, who))
        who, start = who[order], start[order]
        head = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (start[1:] != start[:-1] + 1))) if len(who) else np.zeros(0, np.int64)
        tail = np.append(head[1:], len(who)) - 1 if len(who) else head
        return pa.table({"id": pa.array(ids[who[head]], pa.int64()), "start": pa.array(first[who[head]] + start[head], pa.int64()),
                         "end": pa.array(first[who[tail]] + start[tail] + LENGTH, pa.int64())})

    if not often.isEmpty():
        whole = whole.union(_hot_windows(turned.join(often, "key", "left_semi")))
        strings = turned.join(often, "key", "left_anti")
    edges = (strings.withColumn("bucket", F.pmod(F.xxhash64("a"), F.lit(buckets)).cast("int"))
             .repartitionById(min(buckets, MOST_TASKS), "bucket").groupBy("bucket").applyInArrow(resolve, "id bigint, start bigint, end bigint"))
    return whole.union(edges)


def substring_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep_text: bool = False,
                     bucket_strings: int = BUCKET_STRINGS) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, and the text if asked for.

    Null texts are empty. Rows that share an id but not a text are documents of their own, in
    the order of a hash of their texts; rows that repeat both are one document and lose the
    same bytes. Rows without an id are in no order and stay whole. Kept text may begin or
    end within a character; such bytes become replacement characters.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("name"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    docs = _ordered(docs)
    gone = materialize(repeated_intervals(docs, bucket_strings).groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("gone")), "gone")
    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept string" * keep_text

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                part = batch.slice(at, 500)
                for key, packed, gone in zip(part.column(0).to_pylist(), part.column(1), part.column(2)):
                    text, starts, ends = unpack(packed.as_py()), np.zeros(0, np.int64), np.zeros(0, np.int64)
                    if gone.is_valid:
                        starts, ends = _merged(gone.values.field("start").to_numpy(), gone.values.field("end").to_numpy())
                    edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(text)]
                    rest = b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                    rows.append((key, len(text), len(text) - len(rest), len(starts), hashlib.sha256(rest).hexdigest(),
                                 *([rest.decode("utf-8", "replace")] if keep_text else [])))
                types = [pa.int64()] * 4 + [pa.string()] * 2
                names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    return _packed(docs).join(gone, "id", "left").select("name", "packed", "gone").mapInArrow(kept, schema).withColumnRenamed("id", id_col)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_report(documents(spark, sf_dir))


SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(h) // 2 AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS string FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 99, 0))) AS i FROM b)),
e AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY string ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM e),
t AS (SELECT doc_id, i, count(*) FILTER (before IS NULL OR i > before + 100) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
r AS (SELECT doc_id, min(i) AS first, max(i) + 100 AS past FROM t GROUP BY doc_id, span),
o AS (SELECT *, lag(past, 1, 0) OVER (PARTITION BY doc_id ORDER BY first) AS since FROM r),
k AS (SELECT doc_id, sum(past - first)::BIGINT AS n_removed, count(*) AS n_spans, max(past) AS last,
             string_agg(substr(h, 2 * since + 1, 2 * (first - since)), '' ORDER BY first) AS head
      FROM o JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN k USING (doc_id)
"""
