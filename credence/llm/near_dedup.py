"""MinHash near-dedup by a multi-index Hamming join.

A document's set of 5-word shingles gets a signature of POSITIONS values of BITS bits. Two
sets of similarity s agree in about s of the positions. The signatures are split into
chunks; if two differ in at most CHUNKS * (ERRORS + 1) - 1 positions, then by the pigeonhole
principle some chunk differs in at most ERRORS of its positions, so enumerating which
positions of a chunk may be wrong, and joining on the others, finds all such pairs. That
number is also the signature distance up to which pairs are looked at: 27 of 56, where a
pair of similarity 0.75 differs in 14 on average and in more than 27 with a probability of
0.00003.

Work that grows with groups of copies is kept linear: equal word sequences (by 128 bits of
BLAKE2) are one class; in a bucket of the join all members are paired with its first only;
links are confirmed on the full sets of shingles, as words and not as hashes, and components
are found by star contraction. In large buckets that still hold
several components, members outside the largest are held against some further members,
round by round, as long as that joins a good part of them. What a bucket then has outside
its largest component is held against all its members, block by block: of two linked
members in different components one is outside the largest, so no link between components
is lost. A block has a bounded number of rows and shingles and returns only links that join
components; it holds hashed sets, and what it finds is confirmed on the words too.

Rows are the nodes of the graph: rows that share an id but not a text are linked, or not, by
their own texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import documents, finished, materialize, mix, text_digest, window_hashes, word_digests
from credence.llm.components import components

WIDTH = 5
CHUNKS = 14
CHUNK_POSITIONS = 4
ERRORS = 1
POSITIONS = CHUNKS * CHUNK_POSITIONS
BITS = 16
#: The signature distance up to which every pair is found and looked at.
FARTHEST = CHUNKS * (ERRORS + 1) - 1
SIMILARITY = 75
#: A block of a bucket has about this many rows and shingles at most.
BLOCK_ROWS = 512
BLOCK_SHINGLES = 1 << 19
#: Buckets with more members get rounds of further heads, so many a round, while a round
#: joins at least this share of the members outside the largest components.
LARGE_ROWS = 8 * BLOCK_ROWS
HEADS = 8
WORTH_A_ROUND = 0.2

_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 62, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 1 << 62, POSITIONS, dtype=np.uint64)
#: A bucket's first member is that of one of these orders, by its key, so that a group of
#: copies that shares many buckets is held against several of its members.
_ORDERS = [int(x) for x in _rng.integers(0, 1 << 62, 4)]


def lower_words(text: bytes | None) -> list[bytes]:
    """The words of a text with A-Z in lower case."""
    return (text or b"").lower().split()  # of bytes: A-Z only, and x20, x09-x0D only


def shingle_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    digests = word_digests(words)
    if 0 < len(words) < width:
        return mix(window_hashes(digests, len(words)) + np.uint64(len(words)))
    return np.unique(window_hashes(digests, width))


def shingle_words(words: list[bytes], width: int = WIDTH) -> set:
    """The distinct shingles themselves."""
    if 0 < len(words) < width:
        return {tuple(words)}
    return set(zip(*(words[k:] for k in range(width))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low BITS bits of the least value under each of POSITIONS hash functions."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[at : at + 1024, None] * _A + _B).min(axis=0))
    return (mix(least) & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature, the keys of all chunks with one position left out each."""
    keys = []
    for c in range(CHUNKS):
        own = signatures[:, c * CHUNK_POSITIONS : (c + 1) * CHUNK_POSITIONS].astype(np.uint64)
        for out in range(CHUNK_POSITIONS):
            key = np.full(len(own), np.uint64(c * CHUNK_POSITIONS + out + 1))
            for p in range(CHUNK_POSITIONS):
                if p != out:
                    key = mix(key * np.uint64(65537) + own[:, p])
            keys.append(key)
    return np.stack(keys, axis=1).view(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): rows of one id are told apart by a hash of their texts."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.cast("binary").alias("text"))


def _signed(texts: DataFrame) -> DataFrame:
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2):
                words = lower_words(text.as_py())
                s = shingle_hashes(words)
                rows.append((len(s), *text_digest(b" ".join(words)), signature(s).tobytes() if len(s) else None))
            n, d1, d2, sig = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())],
                names=["id", "h", "n", "d1", "d2", "sig"])

    found = texts.mapInArrow(signed, "id bigint, h bigint, n bigint, d1 bigint, d2 bigint, sig binary")
    return found.withColumn("row", F.monotonically_increasing_id())


def _keys(classes: DataFrame) -> DataFrame:
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, POSITIONS)
            keys = chunk_keys(sigs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.repeat(ids, keys.shape[1]))], names=["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(keyed, "key bigint, rep bigint")


def _differ(a: str, b: str):
    """In how many positions two signatures differ."""
    @F.arrow_udf("int")
    def count(x: pa.Array, y: pa.Array) -> pa.Array:
        left, right = (np.frombuffer(b"".join(v.to_pylist()), np.uint16).reshape(-1, POSITIONS) for v in (x, y))
        return pa.array((left != right).sum(axis=1), pa.int32())

    return count(F.col(a), F.col(b))


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sizes and signatures allow a link."""
    left = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    sized = (pairs.join(left, "a").join(right, "b")
             .filter(100 * F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb")))
    return sized.withColumn("d", _differ("sa", "sb")).filter(F.col("d") <= FARTHEST).select("a", "b")


def _sets(members: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(rep, shingles, words) of the classes that share a bucket with another one: hashes, and the words in lower case."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                words = [lower_words(t.as_py()) for t in part.column(1)]
                own = [shingle_hashes(w).view(np.int64) for w in words]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.list_(pa.int64())), pa.array([b" ".join(w) for w in words], pa.binary())], names=["rep", "shingles", "words"])

    need = members.select("rep").distinct().join(classes.select("rep", F.col("id").alias("own"), F.col("h").alias("own_h")), "rep")
    held = texts.join(need, F.col("id").eqNullSafe(F.col("own")) & (F.col("h") == F.col("own_h"))).select("rep", "text")
    # a row that is repeated whole is there more than once
    return held.mapInArrow(sets, "rep bigint, shingles array<bigint>, words binary").dropDuplicates(["rep"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= 75 * union; shingles are compared by their words."""
    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, tuple[int, set]] = {}

        def shingles(side: int, rep: int, words: pa.Scalar) -> set:
            if side not in last or last[side][0] != rep:  # the join's rows come ordered by one side
                last[side] = (rep, shingle_words(words.as_py().split()))
            return last[side][1]

        for batch in batches:
            stay = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                left, right = shingles(0, a, x), shingles(1, b, y)
                common = len(left & right)
                stay.append(100 * common >= SIMILARITY * (len(left) + len(right) - common))
            yield batch.select([0, 1]).filter(pa.array(stay, pa.bool_()))

    both = (pairs.select("a", "b").join(sets.select(F.col("rep").alias("a"), F.col("words").alias("wa")), "a")
            .join(sets.select(F.col("rep").alias("b"), F.col("words").alias("wb")), "b"))
    return both.select("a", "b", "wa", "wb").mapInArrow(checked, "a bigint, b bigint")


def first_shared(differ: np.ndarray) -> np.ndarray:
    """The first of all chunk keys that two signatures share, from where they differ; -1 without one."""
    errors = differ.reshape(len(differ), CHUNKS, CHUNK_POSITIONS)
    shared = errors.sum(axis=2) <= ERRORS
    chunk = shared.argmax(axis=1)
    rows = np.arange(len(differ))
    # argmax of a chunk without an error is 0, and any of its keys is shared then
    return np.where(shared[rows, chunk], chunk * CHUNK_POSITIONS + errors[rows, chunk].argmax(axis=1), -1)


def block_links(labels: np.ndarray, asks: np.ndarray, answers: np.ndarray, signatures: np.ndarray, sets: list[np.ndarray], slot: int | None = None) -> list[tuple[int, int]]:
    """Links that join components: every row of `asks` held against all of `answers`.

    A forest over the labels, not all pairs: once two components are one, no further link
    between them is looked for. Sets are sorted and without repeats. `slot`: which of the
    chunk keys is the bucket's; pairs that share an earlier one are left to its bucket.
    """
    _, part = np.unique(labels, return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    held = np.flatnonzero(answers)
    found = []
    for i in np.flatnonzero(asks).tolist():
        near = held[(part[held] != part[i]) & (100 * np.minimum(sizes[held], sizes[i]) >= SIMILARITY * np.maximum(sizes[held], sizes[i]))]
        differ = signatures[near] != signatures[i]
        close = differ.sum(axis=1) <= FARTHEST
        near = near[close] if slot is None else near[close][first_shared(differ[close]) == slot]
        if not len(near):
            continue
        flat = np.concatenate([sets[j] for j in near])
        place = np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)
        common = np.add.reduceat(sets[i][place] == flat, np.cumsum(sizes[near]) - sizes[near], dtype=np.int64)
        for j in near[100 * common >= SIMILARITY * (sizes[near] + sizes[i] - common)].tolist():
            if part[j] != part[i]:
                found.append((i, j))
                part[part == part[j]] = part[i]
    return found


def _labelled(members: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, rep, n, label): the members of the buckets with their sizes and components."""
    named = labels.select(F.col("node").alias("rep"), "component")
    return materialize(members.select("key", "rep").join(classes.select("rep", "n"), "rep").join(named, "rep", "left")
                       .select("key", "rep", "n", F.coalesce("component", "rep").alias("label")), "labelled")


def _largest(inside: DataFrame) -> DataFrame:
    """(key, largest): the largest component of each bucket."""
    return (inside.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
            .agg(F.max_by("label", F.struct("n", "label")).alias("largest")))


def _with_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components with further links."""
    return components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def _further_heads(members: DataFrame, classes: DataFrame, labels: DataFrame, sets: DataFrame, large_rows: int) -> tuple[DataFrame, DataFrame]:
    """`labels`, and the labelled members, after rounds of further heads in large buckets.

    Linear work: a round pairs each member outside its bucket's largest component with HEADS
    members of the bucket.
    """
    left, turn = None, 0
    while True:
        labelled = _labelled(members, classes, labels)
        large = (labelled.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
                 .filter((F.col("size") > large_rows) & (F.col("low") < F.col("high"))).select("key"))
        if large.isEmpty():
            return labels, labelled
        inside = materialize(labelled.join(large, "key"), "large")
        outside = materialize(inside.join(_largest(inside), "key").filter("label <> largest").select("key", "rep", "label"), "outside")
        now = outside.count()
        if left is not None and now > (1 - WORTH_A_ROUND) * left:
            return labels, labelled
        left, turn = now, turn + 1
        orders = [int(x) for x in np.random.default_rng(1000 + turn).integers(0, 1 << 62, HEADS)]
        heads = inside.groupBy("key").agg(*[F.min(F.col("rep").bitwiseXOR(F.lit(o))).alias(f"h{k}") for k, o in enumerate(orders)])
        heads = heads.select(F.bitwise_not("key").alias("turned"),
                             F.explode(F.array_distinct(F.array(*[F.col(f"h{k}").bitwiseXOR(F.lit(o)) for k, o in enumerate(orders)]))).alias("head"))
        pairs = (outside.withColumn("turned", F.bitwise_not("key")).join(heads, "turned").filter("rep <> head")
                 .select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct())
        links = materialize(_confirmed(materialize(_near(pairs, classes), "pairs"), sets), "links")
        if links.isEmpty():
            return labels, labelled
        labels = _with_links(labels, links)


def _across(labelled: DataFrame, classes: DataFrame, sets: DataFrame, block_rows: int, block_shingles: int) -> DataFrame:
    """Links between components that share a bucket, by the full sets of hashes."""
    opened = (labelled.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
              .filter("size > 2 and low < high").select("key"))
    inside = materialize(labelled.join(opened, "key"), "inside")
    asking = inside.join(_largest(inside), "key").withColumn("asks", F.col("label") != F.col("largest")).drop("largest")
    blocks = lambda rows, shingles: F.greatest(F.ceil(rows / block_rows), F.ceil(shingles / block_shingles), F.lit(1)).cast("int")
    grid = asking.groupBy("key").agg(
        blocks(F.count_if("asks"), F.sum(F.when(F.col("asks"), F.col("n")).otherwise(0))).alias("asked"),
        blocks(F.count(F.lit(1)), F.sum("n")).alias("answered"))
    placed = asking.join(grid, "key")
    dealt = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "rep"), F.col(n)).cast("int")
    whole = (F.col("asked") == 1) & (F.col("answered") == 1)
    held = ["key", "rep", "label"]
    one = placed.filter(whole).select(*held, "asks", F.lit(True).alias("answers"), F.lit(0).alias("p"), F.lit(0).alias("q"))
    answers = placed.filter(~whole).select(*held, F.lit(False).alias("asks"), F.lit(True).alias("answers"),
                                           F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("p"), dealt(2, "answered").alias("q"))
    asks = placed.filter(~whole & F.col("asks")).select(*held, "asks", F.lit(False).alias("answers"), dealt(1, "asked").alias("p"),
                                                        F.explode(F.sequence(F.lit(0), F.col("answered") - 1)).alias("q"))
    rows = materialize(one.union(answers).union(asks), "blocks").join(classes.select("rep", "sig"), "rep").join(sets.select("rep", "shingles"), "rep")

    def across(table: pa.Table) -> pa.Table:
        reps = table["rep"].to_numpy()
        signatures = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, POSITIONS)
        slot = int(np.flatnonzero(chunk_keys(signatures[:1])[0] == table["key"][0].as_py())[0])
        found = block_links(table["label"].to_numpy(), np.array(table["asks"]), np.array(table["answers"]), signatures,
                            [x.values.to_numpy().view(np.uint64) for x in table["shingles"]], slot)
        i, j = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(np.minimum(reps[i], reps[j]), pa.int64()), "b": pa.array(np.maximum(reps[i], reps[j]), pa.int64())})

    return rows.groupBy("key", "p", "q").applyInArrow(across, "a bigint, b bigint").distinct()


def _verdicts(texts: DataFrame, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES, large_rows: int = LARGE_ROWS) -> DataFrame:
    """One row per row of (id, h, text): id, h, n, component_id, kept."""
    signed = materialize(_signed(texts), "signatures")
    least = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row", "h")).alias("least")
    classes = materialize(
        signed.filter("n > 0").groupBy("n", "d1", "d2").agg(least, F.first("sig").alias("sig"))
        .select("n", "d1", "d2", "sig", F.col("least.row").alias("rep"), F.col("least.id").alias("id"), F.col("least.h").alias("h")), "classes")
    keys = _keys(classes)
    order = F.col("rep").bitwiseXOR(F.get(F.array(*map(F.lit, _ORDERS)), F.pmod("key", F.lit(len(_ORDERS))).cast("int")))
    ends = keys.groupBy("key").agg(F.min(order).alias("first"), F.max(order).alias("last")).filter("first < last")
    members = materialize(keys.withColumn("turned", F.bitwise_not("key")).join(ends.select(F.bitwise_not("key").alias("turned"), "first"), "turned")
                          .select("key", "rep", order.bitwiseXOR(F.col("first")).bitwiseXOR(F.col("rep")).alias("head")), "members")
    pairs = members.filter("rep <> head").select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct()
    near = materialize(_near(pairs, classes), "pairs")
    sets = materialize(_sets(members, texts, classes), "sets")
    links = materialize(_confirmed(near, sets), "links")
    labels, labelled = _further_heads(members, classes, components(links), sets, large_rows)
    more = materialize(_across(labelled, classes, sets, block_rows, block_shingles), "pairs")
    if not more.isEmpty():
        labels = _with_links(labels, materialize(_confirmed(more, sets), "links"))
    node = F.coalesce("component", "rep")
    # a copy's row of all its class: the key is turned so that Spark may split a hot component
    joined = classes.select("n", "d1", "d2", "rep", "id").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("node", node)
    heads = joined.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", F.col("rep").alias("row"))).alias("stays"))
    named = (joined.withColumn("turned", F.bitwise_not("node")).join(heads.select(F.bitwise_not("node").alias("turned"), "stays"), "turned")
             .select((-F.col("n")).alias("minus"), "d1", "d2", "stays"))
    rows = signed.select("row", "id", "h", "n", "d1", "d2", F.when(F.col("n") > 0, -F.col("n")).alias("minus"))
    return rows.join(named, ["minus", "d1", "d2"], "left").select(
        "id", "h", "n", F.when(F.col("stays").isNull(), F.col("id")).otherwise(F.col("stays.id")).alias("component_id"),
        (F.col("stays").isNull() | (F.col("row") == F.col("stays.row"))).alias("kept"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES, large_rows: int = LARGE_ROWS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Null and empty texts have no shingles and are linked with nothing. Rows are nodes, also
    those that share an id; component_id is the least id of a row's component, null ids
    coming last. Of a component exactly one row is kept, of rows with its least id any one.
    """
    return _verdicts(_texts(docs, id_col, text_col), block_rows, block_shingles, large_rows).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one of each group, with their own columns.

    Rows go by id and text together, so a row that shares its id with another stays or goes
    by its own text. Of rows that repeat both, and have words, one stays.
    """
    verdicts = _verdicts(_texts(docs, id_col, text_col)).groupBy("id", "h").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("stay")).filter("stay < rows")
    verdicts = materialize(verdicts.select(F.col("id").alias("gone_id"), F.col("h").alias("gone_h"), "stay"), "verdicts")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col(id_col).cast("bigint").alias("gone_id"),
                       F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("gone_h"))
    of = lambda rows: held["gone_id"].eqNullSafe(rows["gone_id"]) & (held["gone_h"] == rows["gone_h"])
    stay = held.join(verdicts, of(verdicts), "left_anti").select("record.*")
    repeated = verdicts.filter("stay > 0")
    if repeated.isEmpty():
        return stay
    one = held.join(repeated, of(repeated), "left_semi").groupBy("gone_id", "gone_h").agg(F.first("record").alias("record"))
    return stay.unionByName(one.select("record.*"))


@finished
def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT DISTINCT doc_id AS x, doc_id AS y FROM documents UNION SELECT e.y, r.y FROM r JOIN e ON e.x = r.x),
g AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN g USING (doc_id) LEFT JOIN n USING (doc_id)
"""
