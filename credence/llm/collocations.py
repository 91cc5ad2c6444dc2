"""Collocations by Toivonen's mining: a sample proposes, full passes decide.

Phrases are runs of up to LONGEST words within a piece of a text, counted by language. A
phrase is frequent only if its parts, without the last and without the first word, are. A
sample of the documents is mined first, level by level, at a threshold below the sample's
share of MINIMUM. What it finds, S, and S's negative border (phrases outside S whose parts are
in S) are then counted over all documents in one pass: a pass counts just the phrases of a
text whose two parts are in S, so the border is never listed.

That pass counts by hash, four bytes a phrase, and nearly all of the border proves rare. What
reaches MINIMUM is counted again in a second pass, now by the phrases themselves. If some of it
is in the border, these are failures of the sample, and the second pass also counts what they
let in: phrases with a part that is a failure or has itself been let in, to any length.
That closes the search: the parts of a frequent phrase are frequent, so by induction they were
counted, and the phrase was either counted in the first pass, and again, or is let in. Phrases
that share a hash cost a second count; none is missed or given another's count.

Sets of phrases are sent to the tasks as bitmaps of bounded size, supersets of the set: what they
take in by accident is counted too, which costs time and changes no count. Tasks count chunks
of text of bounded size; counts leave a task sorted and in slices of the hashes' range and meet by slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.llm.common import documents, finished, materialize, mix

LONGEST = 5
MINIMUM = 100
TOP = 2000
#: The sample has about one in so many documents; which ones depends on id and text only.
SAMPLED = 8
#: A chunk of texts that a task counts at once, in bytes; a longer text is a chunk of its own.
CHUNK = 2 << 20
#: Bits of the bitmap: so many per word that is frequent in the sample, within these bounds.
BITS_PER_WORD = 128
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
#: Counts that a task gathers before they leave it.
GATHERED = 2_000_000
#: Phrases that a task gathers before it sums them, or they leave it.
NAMED = 1_000_000
#: Bits of the number of slices, and words of the corpus for one slice beyond.
LEAST_SLICES = 10
SLICE_WORDS = 1 << 20
_BUCKETS = 64
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10)
_SPACES = bytes.maketrans(b".,;:!?", b" " * 6)
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def sample_threshold(minimum: int, sampled: int) -> int:
    """Occurrences in the sample from which a phrase is proposed: the mean of a phrase that just reaches the minimum, less 1.5 deviations."""
    mean = minimum / sampled
    return max(2, int(mean - 1.5 * mean**0.5))


def _tokens(texts: list[bytes]) -> list[bytes]:
    """The words of all texts in lower case; b"." stands between pieces and texts."""
    return b" . ".join([t.lower().translate(_ENDS).replace(b".", b" . ") for t in texts]).split()


class Bitmap:
    """A superset of a set of 64-bit hashes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # of uint64

    def has(self, hashes: np.ndarray) -> np.ndarray:
        size = np.uint64(64 * len(self.bits) - 1)
        found = np.ones(len(hashes), bool)
        for h in (hashes, hashes * _SECOND >> np.uint64(20)):
            slot = h & size
            found &= (self.bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found

    @staticmethod
    def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
        size = np.uint64(bits - 1)
        return np.concatenate([hashes & size, hashes * _SECOND >> np.uint64(20) & size])


def _first(lang: str | None, words: list[bytes]) -> np.ndarray:
    """Hashes of phrases of one word."""
    seed = xxhash.xxh3_64_intdigest((lang or "").encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _longer(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    return mix(hashes * np.uint64(0x9E3779B97F4A7C15) + last)


def count_phrases(texts: list[bytes], lang: str | None, known: Bitmap | None, shift: int, *, low: int = 1, high: int = LONGEST,
                  found: Bitmap | None = None) -> Iterator[tuple[np.ndarray, pa.Array | None, np.ndarray]]:
    """(hashes, phrases or None, counts) of the phrases of low to high words whose parts, and their parts, are in `known`.

    By hash only, unless there is `found`, what proved frequent: then those in it, and what its members outside
    `known` let in, by phrase. Bitmaps have hashes without their last `shift` bits.
    """
    tokens = _tokens(texts)
    places: dict[bytes, int] = {b".": 0}
    ids = np.fromiter((places.setdefault(w, len(places)) for w in tokens), np.int64, len(tokens))
    del tokens
    words = list(places)
    taken = pa.array(words, pa.binary()) if found else None
    here = _first(lang, words)[ids]
    hashes = here.copy()  # of the phrase of n words at each place that holds one
    place, first_pass = np.flatnonzero(ids > 0), None  # where there are candidates, and which the first pass counted
    numbered, distinct = ids[place] - 1, len(words) - 1
    for n in range(1, high + 1):
        if not len(place):
            return
        first = np.zeros(distinct, np.int64)
        first[numbered[::-1]] = place[::-1]
        own = hashes[first]
        short = own >> np.uint64(shift)
        has = known.has(short) if known else None
        if found:
            counted = np.ones(distinct, bool) if first_pass is None else first_pass
            before, has = counted & has, found.has(short) | ~counted
        if n >= low:
            at = np.flatnonzero(has) if found else np.arange(distinct)
            if len(at):
                parts = [taken.take(pa.array(ids[first[at] + k])) for k in range(n)] if found else []
                yield own[at], pc.binary_join_element_wise(*parts, b" ") if found else None, np.bincount(numbered, minlength=distinct)[at]
        if n == high:
            return
        # phrases of n + 1 words whose parts are both there; at the last places there is none
        hit = np.zeros(len(ids), bool)
        hit[place] = has[numbered]
        code = np.zeros(len(ids), np.int64)
        code[place] = numbered
        following = np.flatnonzero(hit[:-1] & hit[1:])
        last = ids[following + n]
        if found:
            hit_before = np.zeros(len(ids), bool)
            hit_before[place] = before[numbered]
            was_here = hit_before[following] & hit_before[following + 1]
        numbered, keys = pd.factorize(code[following] * len(words) + last)
        place, distinct = following, len(keys)
        if found:
            first_pass = np.zeros(distinct, bool)
            first_pass[numbered] = was_here  # alike at all its places
        hashes[place] = _longer(hashes[place], here[place + n])


class _Gathered:
    """Counts by hash, which leave sorted and in slices: the leading bits of a hash name the slice, 32 bits follow."""

    def __init__(self, bits: int):
        self.bits = bits  # of the number of slices
        self.hashes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.hashes.append(hashes >> np.uint64(32 - self.bits))
        self.counts.append(counts)
        self.size += len(hashes)

    def slices(self) -> tuple[list[int], list[bytes], list[bytes]]:
        """Slice numbers, and for each its hashes' 32 bits and counts."""
        hashes, counts = added(np.concatenate(self.hashes), np.concatenate(self.counts))
        self.__init__(self.bits)
        number = (hashes >> np.uint64(32)).astype(np.int64)
        start = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        ends = [*start[1:].tolist(), len(number)]
        short, counts = hashes.astype(np.uint32), counts.astype(np.uint32)
        cut = [(s, e) for s, e in zip(start.tolist(), ends)]
        return number[start].tolist(), [short[s:e].tobytes() for s, e in cut], [counts[s:e].tobytes() for s, e in cut]


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(counts[order], start) if len(keys) else counts


def _by_lang(batch: pa.RecordBatch, chunk: int) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, of about `chunk` bytes at most."""
    waiting: dict[str, tuple[list[bytes], list[int]]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        held, size = waiting.setdefault(lang, ([], [0]))
        held.append(text.as_py())
        size[0] += len(held[-1])
        if size[0] >= chunk:
            del waiting[lang]
            yield lang, held
    for lang, (held, _) in waiting.items():
        yield lang, held


def _hashed(texts: DataFrame, slice_bits: int, known=None, *, low: int = 1, high: int = LONGEST, chunk: int = CHUNK) -> DataFrame:
    """(slice, hashes, counts) of the phrases, as tasks gather them."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Gathered(slice_bits)

        def cut() -> pa.RecordBatch:
            numbers, hashes, counts = gathered.slices()
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], names=["slice", "hashes", "counts"])

        for batch in batches:
            for lang, held in _by_lang(batch, chunk):
                for hashes, _, counts in count_phrases(held, lang, known and known.value, 32 - slice_bits, low=low, high=high):
                    gathered.add(hashes, counts)
                    if gathered.size >= GATHERED:
                        yield cut()
        if gathered.size:
            yield cut()

    return texts.mapInArrow(made, "slice int, hashes binary, counts binary")


def _frequent(counts: DataFrame, minimum: int, groups: int) -> DataFrame:
    """(hash): the hashes, without their last bits, that reach the minimum; slices meet in so many groups."""
    def met(table: pa.Table) -> pa.Table:
        short = [np.frombuffer(x, np.uint32) for x in table["hashes"].to_pylist()]
        slices = np.repeat(table["slice"].to_numpy().astype(np.uint64), [len(x) for x in short])
        keys, sums = added((slices << np.uint64(32)) + np.concatenate(short), np.concatenate([np.frombuffer(x, np.uint32) for x in table["counts"].to_pylist()]).astype(np.int64))
        return pa.table({"hash": pa.array(keys[sums >= minimum].view(np.int64))})

    return counts.groupBy(F.pmod("slice", F.lit(groups))).applyInArrow(met, "hash bigint")


def _named(texts: DataFrame, slice_bits: int, known, found, minimum: int, chunk: int = CHUNK) -> DataFrame:
    """(lang, phrase, n) of the phrases that reach the minimum, of those that did so by hash and of what is let in."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by(["slice", "lang", "phrase"]).aggregate([("n", "sum")])

        def cut() -> pa.RecordBatch:
            table = summed().sort_by("slice").combine_chunks()
            number = table["slice"].to_numpy()
            start = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            offsets = pa.array(np.append(start, len(number)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, table[name].combine_chunks()) for name in ("lang", "phrase", "n_sum")]
            return pa.RecordBatch.from_arrays([pa.array(number[start], pa.int32()), *lists], names=["slice", "langs", "phrases", "counts"])

        for batch in batches:
            for lang, texts_ in _by_lang(batch, chunk):
                for hashes, phrases, counts in count_phrases(texts_, lang, known.value, 32 - slice_bits, found=found.value):
                    slices = (hashes >> np.uint64(64 - slice_bits)).astype(np.int32)
                    held.append(pa.table({"slice": pa.array(slices), "lang": pa.repeat(pa.scalar(lang, pa.string()), len(counts)), "phrase": phrases.cast(pa.string()), "n": pa.array(counts.astype(np.int64))}))
                    size += len(counts)
                if size >= NAMED:
                    held = [summed().rename_columns(["slice", "lang", "phrase", "n"])]
                    size = held[0].num_rows
                    if size >= NAMED // 2:  # little repeats: these leave
                        yield cut()
                        held, size = [], 0
        if size:
            yield cut()

    def met(table: pa.Table) -> pa.Table:
        flat = pa.table({name: pc.list_flatten(table[column]) for name, column in (("lang", "langs"), ("phrase", "phrases"), ("n", "counts"))})
        sums = flat.group_by(["lang", "phrase"]).aggregate([("n", "sum")])
        return sums.filter(pc.greater_equal(sums["n_sum"], minimum)).rename_columns(["lang", "phrase", "n"])

    rows = texts.mapInArrow(made, "slice int, langs array<string>, phrases array<string>, counts array<bigint>")
    return rows.groupBy("slice").applyInArrow(met, "lang string, phrase string, n bigint")


def _totals(texts: DataFrame) -> DataFrame:
    """(lang, n): the words of each language."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(t.as_py().translate(_SPACES).split()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["lang", "n"])

    return texts.mapInArrow(made, "lang string, n bigint").groupBy("lang").agg(F.sum("n").alias("n")).filter("n > 0")


def bitmap_bits(phrases: int) -> int:
    """A power of two with BITS_PER_WORD for each of them, within bounds."""
    return 1 << int(np.clip((BITS_PER_WORD * max(1, phrases) - 1).bit_length(), LEAST_BITS.bit_length() - 1, MOST_BITS.bit_length() - 1))


def _bitmap(phrases: DataFrame, bits: int, before: Bitmap | None = None) -> Bitmap:
    """`before` with the hashes of phrases: bits are set in words of 64, of which there are bits / 64 at most."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = Bitmap.slots(batch.column(0).to_numpy().view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (slots & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    set_bits = phrases.select("hash").mapInArrow(made, "word int, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(bits // 64, np.uint64) if before is None else before.bits.copy()
    held[set_bits["word"].to_numpy()] |= set_bits["bits"].to_numpy().view(np.uint64)
    return Bitmap(held)


def frequent_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
                     minimum: int = MINIMUM, sampled: int = SAMPLED, threshold: int | None = None, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of every phrase of 1 to LONGEST words with n >= minimum, and (lang, n) of all words.

    `threshold`: from how many occurrences in the sample a phrase is proposed; it and `sampled` decide
    how much is counted in which pass, never what comes out.
    """
    sc = docs.sparkSession.sparkContext
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), text.cast("binary").alias("text"),
                        F.pmod(F.xxhash64(F.lit(12), F.col(f"`{id_col}`").cast("string"), text), F.lit(sampled)).alias("dealt"))
    sample = materialize(texts.filter("dealt = 0").select("lang", "text"), "sample")
    texts = texts.select("lang", "text")
    totals = materialize(_totals(texts), "totals")
    words = totals.agg(F.sum("n")).first()[0] or 0
    slice_bits = max(LEAST_SLICES, (words // SLICE_WORDS).bit_length())
    enough, groups = threshold or sample_threshold(minimum, sampled), max(1, (1 << slice_bits) // sampled)
    proposed = materialize(_frequent(_hashed(sample, slice_bits, high=1, chunk=chunk), enough, groups), "words")
    bits = bitmap_bits(proposed.count())
    known = _bitmap(proposed, bits)
    for n in range(2, LONGEST):  # phrases of LONGEST words are no part of any
        sent = sc.broadcast(known)
        known = _bitmap(_frequent(_hashed(sample, slice_bits, sent, low=n, high=n, chunk=chunk), enough, groups), bits, known)
        sent.unpersist()
    sent = sc.broadcast(known)
    reached = materialize(_frequent(_hashed(texts, slice_bits, sent, chunk=chunk), minimum, 1 << slice_bits), "reached")
    found = sc.broadcast(_bitmap(reached, bitmap_bits(reached.count())))
    return materialize(_named(texts, slice_bits, sent, found, minimum, chunk), "phrases"), totals


def _best(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    """The first `top` rows of each language, with their rank: first of each of its buckets, then of these."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(_BUCKETS)).cast("int"))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(*order))).filter(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top).drop("bucket")


def collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, minimum: int = MINIMUM, top: int = TOP,
                 sampled: int = SAMPLED, threshold: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A candidate is a phrase of 2 to LONGEST words that occurs a >= minimum times. Cut after
    its first k words, the parts occur l and r times, and of n words of the language the score
    is floor(1000 * a * n / (l * r)), in decimals of 38 digits; the cut with the least score
    counts, of equal ones that with the least k. A candidate within a longer one that occurs as
    often is left out; by its own extensions by one word, as those between them occur as often too.

    Null texts are empty, a null language is `und`, every row counts, also those that repeat
    an id or a text. Languages without words, and an empty table, give no rows; further
    columns are not read.
    """
    found, total = frequent_phrases(docs, id_col, text_col, lang_col, minimum=minimum, sampled=sampled, threshold=threshold, chunk=chunk)
    words = F.split("phrase", " ")
    named = found.withColumn("words", words).withColumn("size", F.size("words"))
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    candidates = named.filter("size >= 2")
    longer = (candidates.filter("size > 2").select("lang", "n", F.explode(F.array_distinct(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1)))).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("n").alias("longer")))
    left = candidates.join(longer, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < n")
    cuts = left.select("lang", "phrase", F.col("n").alias("a"), "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    counts = lambda key, value: found.select(F.col("lang"), F.col("phrase").alias(key), F.col("n").alias(value))
    known = cuts.join(counts("first", "l"), ["lang", "first"]).join(counts("rest", "r"), ["lang", "rest"]).join(total, "lang")
    score = F.expr("CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0)) DIV (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))").cast("bigint")
    scored = known.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    return _best(rows, ["lang"], top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@finished
def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
o AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) r(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM o GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
q AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE f >= 100),
c AS (SELECT * FROM q WHERE k >= 2),
b AS (SELECT lang, unnest([array_to_string(ws[1:k - 1], ' '), array_to_string(ws[2:k], ' ')]) AS phrase, f FROM c WHERE k > 2),
m AS (SELECT lang, phrase, max(f) AS f FROM b GROUP BY ALL),
left_over AS (SELECT c.* FROM c LEFT JOIN m USING (lang, phrase) WHERE m.f IS NULL OR 100 * m.f < 100 * c.f),
u AS (SELECT lang, phrase, f, k, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:k], ' ') AS tail FROM left_over, range(1, 5) x(j) WHERE j < k),
s AS (SELECT u.lang, u.phrase, u.f AS a, u.j, l.f AS l, r.f AS r, t.n, 1000::HUGEINT * u.f * t.n // (l.f::HUGEINT * r.f) AS score
      FROM u JOIN q l ON l.lang = u.lang AND l.phrase = u.head JOIN q r ON r.lang = u.lang AND r.phrase = u.tail JOIN t ON t.lang = u.lang),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM s),
y AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM y WHERE rank <= 2000
"""
