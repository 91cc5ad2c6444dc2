"""How filters interact: what each removes in every order of application, per part.

Each document's failures are found in one pass; documents are numbered, and the numbers of
those that fail a filter make a sorted posting list for each part, filter and range of
numbers, with two more lists for documents that are labelled good and toxic. A range has at
most RANGE numbers, so a list is bounded however large a part is, and a part with a third of
all documents is as many ranges as it needs. On each range the union of every set of filters
grows by one list at a time: the new list is galloped through the union (the shorter of two
sorted lists looks its numbers up in the longer), what is not there is its difference, and
the union takes that in. Sizes of differences, and of their cuts with the labelled lists, are
summed over ranges. An order's steps are these differences for the filters before.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm.common import documents, materialize

FILTERS = "ABCDE"
#: Numbers of a range, the bound of a posting list.
RANGE = 1 << 16
_LISTS = (*FILTERS, "good", "toxic")
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"
_ALL = (1 << len(FILTERS)) - 1


def text_failures(text: bytes | None, code_points: int) -> int:
    """Bits of the filters A to D that a text fails: few words, repeated words, capitals, symbols."""
    text = text or b""
    words = text.split()  # of bytes: x20, x09-x0D only
    n = len(words)
    bits = n < 50
    bits |= (100 * len(set(words)) < 65 * n) << 1
    bits |= (100 * (len(text) - len(text.translate(None, _UPPER))) > 5 * code_points) << 2
    bits |= (len(text.translate(None, _SYMBOLS)) < len(text)) << 3
    return int(bits)


def _failures(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, digest, bits, row), written once so that the numbers of rows stay."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [text_failures(t.as_py(), n) for t, n in zip(batch.column(3), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.select([0, 1, 2]).columns, pa.array(bits, pa.int32())], names=["id", "part", "digest", "bits"])

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("digest"), text.cast("binary").alias("text"), F.length(text).alias("code_points"))
    found = rows.mapInArrow(made, "id bigint, part string, digest binary, bits int")
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "failures")


def _with_copies(rows: DataFrame) -> DataFrame:
    """`rows` with the bit of filter E: a smaller id has the same text."""
    # a null id comes after all others
    least = (rows.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND least IS NOT NULL")
             .select(F.reverse(F.hex("digest")).alias("turned"), "least"))
    joined = rows.withColumn("turned", F.reverse(F.hex("digest"))).join(least, "turned", "left")
    copied = F.col("least").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("least")))
    return joined.select("id", "part", "row", (F.col("bits") + F.when(copied, 1 << 4).otherwise(0)).alias("bits"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """`rows` with good and toxic: whether any label of the id says so."""
    marks = (labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
             .filter("good = 1 OR toxic = 1").select(F.bitwise_not("id").alias("turned"), "good", "toxic"))
    return rows.withColumn("turned", F.bitwise_not("id")).join(marks, "turned", "left").drop("turned", "id")


def posting_lists(rows: DataFrame, numbers: int = RANGE) -> DataFrame:
    """(part, range, n, one sorted list of row numbers for each of the filters and labels)."""
    last = lambda condition: F.sort_array(F.collect_list(F.when(condition, (F.col("row") % numbers).cast("int"))))
    lists = [last(F.col("bits").bitwiseAND(1 << k) != 0).alias(name) for k, name in enumerate(FILTERS)]
    lists += [last(F.col(name) == 1).alias(name) for name in ("good", "toxic")]
    return rows.groupBy("part", F.floor(F.col("row") / numbers).alias("range")).agg(F.count(F.lit(1)).alias("n"), *lists)


def gallop(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each number of `a` has its place in `b`, and whether it is there; both sorted."""
    place = np.searchsorted(b, a)
    there = np.zeros(len(a), bool)
    inside = place < len(b)
    there[inside] = b[place[inside]] == a[inside]
    return place, there


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sorted lists share; the shorter gallops through the longer."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    return int(gallop(a, b)[1].sum())


def differences(lists: dict[str, np.ndarray]) -> list[tuple[int, int, int, int, int]]:
    """(before, filter, removed, good, toxic) for each set of filters and one more that is not in it."""
    unions = {0: np.zeros(0, np.int64)}
    out = []
    for before in range(_ALL + 1):
        union = unions[before]
        for k, name in enumerate(FILTERS):
            if before >> k & 1:
                continue
            place, there = gallop(lists[name], union)
            new = lists[name][~there]
            out.append((before, k, len(new), common(new, lists["good"]), common(new, lists["toxic"])))
            if before | 1 << k not in unions:
                unions[before | 1 << k] = np.insert(union, place[~there], new)
    return out


def _sizes(postings: DataFrame) -> DataFrame:
    """(part, before, filter, n, listed, removed, good, toxic), summed over ranges."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, rows = [], []
            for r in range(batch.num_rows):
                lists = {name: batch.column(3 + k)[r].values.to_numpy() for k, name in enumerate(_LISTS)}
                n = batch.column(2)[r].as_py()
                found = [(before, k, n, len(lists[FILTERS[k]]), *sizes) for before, k, *sizes in differences(lists)]
                parts += [batch.column(0)[r].as_py()] * len(found)
                rows += found
            if rows:
                held = np.array(rows, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), *(pa.array(x) for x in held)],
                                                 names=["part", "before", "filter", "n", "listed", "removed", "good", "toxic"])

    counted = postings.mapInArrow(made, "part string, before bigint, filter bigint, n bigint, listed bigint, removed bigint, good bigint, toxic bigint")
    return counted.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in ("n", "listed", "removed", "good", "toxic")])


def steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, before, filter, after): all steps of all orders, 600 rows."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            rows.append(("".join(FILTERS[x] for x in order), k + 1, before, f, before | 1 << f))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, before bigint, filter bigint, after bigint")


def _chains(spark: SparkSession) -> DataFrame:
    """(after, before, filter): the differences whose sizes add up to the union of `after`, its filters in the order of their letters."""
    rows = []
    for after in range(1, _ALL + 1):
        before = 0
        for k in range(len(FILTERS)):
            if after >> k & 1:
                rows.append((after, before, k))
                before |= 1 << k
    return spark.createDataFrame(rows, "after bigint, before bigint, filter bigint")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", *, numbers: int = RANGE) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text counts as empty, a null part as the empty string. Equal texts are found by
    their SHA-256; a row of theirs fails E if a smaller id has the text, so rows that repeat
    the least id do not, and a null id comes after all others. Every row counts, also those
    that repeat an id. `labels` has doc_id, quality and toxic; a document is good or toxic if
    any label of its id says so, and nulls say nothing. Empty tables give an empty result.
    Further columns, whatever their names, are not read.
    """
    rows = _labelled(_with_copies(_failures(docs, id_col, text_col, part_col)), labels)
    sizes = materialize(_sizes(posting_lists(rows, numbers)), "sizes")
    filters = len(FILTERS)
    before = F.bit_count("before")
    # in how many orders just the filters of `before` come first: the orders of these times those of the rest
    ways = F.element_at(F.array(*[F.lit(factorial(k) * factorial(filters - 1 - k)) for k in range(filters)]), before.cast("int") + 1)
    overall = sizes.groupBy("part", "filter").agg(F.max(F.when(before == filters - 1, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * ways).alias("shapley"))
    spark = docs.sparkSession
    step = F.broadcast(steps(spark))  # 600 rows
    united = sizes.join(F.broadcast(_chains(spark)), ["before", "filter"]).groupBy("part", "after").agg(F.sum("removed").alias("gone"))
    joined = sizes.join(step, ["before", "filter"]).join(overall, ["part", "filter"]).join(united, ["part", "after"])
    return joined.select("part", "filter_order", "step", (F.col("n") - F.col("gone")).alias("kept"), "removed", (F.col("listed") - F.col("removed")).alias("redundant"),
                         "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
first AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
             (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > least)::INT AS bits
      FROM d JOIN first USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, bits, count(*) AS n, sum(good)::BIGINT AS good, sum(bad)::BIGINT AS bad FROM f GROUP BY ALL),
x AS (SELECT unnest([1, 2, 4, 8, 16]) AS b, unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bs
      FROM x a, x b, x c, x d, x e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, k AS step, bs[k] AS own, CASE WHEN k > 1 THEN list_sum(bs[:k - 1]) ELSE 0 END::INT AS before FROM o, range(1, 6) r(k)),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN bits & (before | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN bits & own <> 0 AND bits & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN bits = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN bits & own <> 0 AND bits & before = 0 THEN bad ELSE 0 END)::BIGINT AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
