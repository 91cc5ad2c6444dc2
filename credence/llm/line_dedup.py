"""Line dedup by a deletion-neighbourhood join.

A line is a sequence of units: its words, or, if it has fewer than UNITS words, its
characters with white space made single spaces. It goes if a line before it of the same
kind, in order of document id and line number, is within the edit bound: one unit inserted,
deleted or replaced, where both have at least UNITS units, so that an edit is at most an
eighth of a line; lines that are shorter still must be equal. Lines without words stay.

Equal lines are found first, by 128 bits of BLAKE2, with map-side combine. Of each distinct line the
earliest occurrence is compared further. Two lines one edit apart agree in at least the
first or the last half of their units, so lines that share neither half with another are
left out, which is most. The others emit every variant with one unit left out, as hashed
keys with the place of the gap: equal variants with the same gap differ by a replacement,
a variant that equals a whole line by a deletion. Per key only the earliest line is kept as
a witness, so a template with very many fillings costs one row each. The unit sequences of
line and witness, words or characters and not their hashes, are compared before the line goes.
The keys are polynomials modulo the prime 2**61 - 1 in digests of the units, two of them with
multipliers of their own.

A document is an id and a text (named by its hash): rows that share an id but not a text are
documents of their own, in the order of that hash; rows that repeat both are one document
and lose the same lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.llm.common import documents, finished, materialize, mix, text_digest, white_space, word_digests, word_spans

UNITS = 8
#: Bytes of short texts that are taken together.
TOGETHER = 1 << 18
_PRIME = (1 << 61) - 1
#: Multipliers of the two polynomials.
_BASES = (0x0B7E151628AED2A7, 0x1C90FDAA22168C23)
_SECOND = np.uint64(0xA0761D6478BD642F)
_61, _31, _30 = np.uint64(61), np.uint64(31), np.uint64(30)
_P, _M31, _M30 = np.uint64(_PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1."""
    x = (x >> _61) + (x & _P)
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1 of numbers below it, by halves of 31 and 30 bits."""
    au, ad, bu, bd = a >> _31, a & _M31, b >> _31, b & _M31
    middle = ad * bu + au * bd
    return _folded((au * bu << np.uint64(1)) + (middle >> _30) + ((middle & _M30) << _31) + ad * bd)


_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**61 - 1 for i < n, grown as needed and kept per process."""
    held = _powers.get(base, np.ones(1, np.uint64))
    while len(held) < n:
        held = np.concatenate([held, _times(held, np.uint64(pow(base, len(held), _PRIME)))])
    _powers[base] = held
    return held[:n]


def _lines_of(text: bytes | None) -> Iterator[tuple[int, list[bytes]]]:
    """Number and words of each line with words."""
    for number, line in enumerate((text or b"").split(b"\n")):
        words = line.split()  # of bytes: x20, x09-x0D only
        if words:
            yield number, words


def _decoded(text: bytes) -> str:
    return text.decode("utf-8", "replace")


def _characters(line: str) -> np.ndarray:
    """A hash of each character."""
    return mix(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64))


class _Sums:
    """Prefix sums of a sequence of digests under a polynomial: hashes of any part in one step."""

    def __init__(self, units: np.ndarray, second: bool = False):
        base = _BASES[second]
        self.inverse = _power_table(pow(base, -1, _PRIME), len(units) + 2)
        terms = _times(_folded(mix(units ^ _SECOND) if second else units), _power_table(base, len(units)))
        self.sums = np.zeros(len(units) + 1, np.uint64)
        high, low = np.cumsum(terms >> _31), np.cumsum(terms & _M31)
        self.sums[1:] = _folded(_times(_folded(high), np.uint64(1 << 31)) + _folded(low))

    def _between(self, start, end) -> np.ndarray:
        return _folded(self.sums[end] + _P - self.sums[start])

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(_times(self._between(start, end), self.inverse[start]) + ((end - start).astype(np.uint64) << _61) + (end - start).astype(np.uint64) * _SECOND)

    def without(self, first: np.ndarray, last: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Hashes of first..last with the unit at the gap left out, as `part` has them."""
        raw = _folded(self._between(first, gap) + _times(self._between(gap + 1, last), self.inverse[1]))
        left = (last - first - 1).astype(np.uint64)
        return mix(_times(raw, self.inverse[first]) + (left << _61) + left * _SECOND)


def _halves(sums: _Sums, first: np.ndarray, last: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of the half that two lines one edit apart share, at either end; the kind is part of them."""
    n = last - first
    out = []
    for h in (n // 2, (n + 1) // 2):  # half of the longer line, this one or one unit longer
        h = np.minimum(h, n)
        tag = h.astype(np.uint64) * np.uint64(4) + np.uint64(2 * kind)
        out += [mix(sums.part(first, first + h) + tag), mix(sums.part(last - h, last) + tag + np.uint64(1))]
    return np.stack(out, axis=1)


def _spaced(buf: np.ndarray) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Where the words of a text start, the words with one space after each, and where each begins there."""
    starts, ends = word_spans(buf)
    white = white_space(buf)
    kept = ~white
    kept[1:] |= ~white[:-1]
    spaced = np.where(white, 32, buf).astype(np.uint8)[kept].tobytes() + b" "
    return starts, spaced, np.append(0, np.cumsum(ends - starts + 1))


def _lines(docs: DataFrame, units: int) -> DataFrame:
    """id, h, line, 128 bits of digest, keys of the halves of lines that may have near ones."""
    def hashed(texts: list[bytes]) -> tuple[np.ndarray, list[pa.Array]] | None:
        """Of some texts end to end, each from a new line on: the text and the columns of each line with words."""
        together = b"\n".join(texts)
        buf = np.frombuffer(together, np.uint8)
        starts, spaced, at = _spaced(buf)
        if not len(starts):
            return None
        breaks = np.flatnonzero(buf == 10)
        lines, first = np.unique(np.searchsorted(breaks, starts), return_index=True)
        last = np.append(first[1:], len(starts))
        sizes = np.array([len(t) for t in texts], np.int64)
        new = np.searchsorted(breaks, np.cumsum(sizes + 1) - sizes - 1)  # the line that each text begins with
        row = np.searchsorted(new, lines, side="right") - 1
        own = [spaced[s : e - 1] for s, e in zip(at[first].tolist(), at[last].tolist())]
        one, two = zip(*map(text_digest, own))
        halves = _halves(_Sums(word_digests(together.split())), first, last, 0)
        few = last - first < units
        told = ~few
        if few.any():  # the characters of all short lines end to end
            marks = [_decoded(own[k]) for k in np.flatnonzero(few).tolist()]
            until = np.cumsum([len(m) for m in marks])
            since = np.append(0, until[:-1])
            halves[few] = _halves(_Sums(_characters("".join(marks))), since, until, 1)
            told[few] = until - since >= units
        offsets = np.append(0, np.cumsum(np.where(told, halves.shape[1], 0))).astype(np.int32)
        held = pa.ListArray.from_arrays(pa.array(offsets), pa.array(halves[told].ravel().view(np.int64)))
        return row, [pa.array(lines - new[row], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), held]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(pc.fill_null(pc.binary_length(batch.column(2)), 0), np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // TOGETHER)) + 1
            for at, until in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                made = hashed([x or b"" for x in batch.column(2)[at:until].to_pylist()])
                if made:
                    ids = batch.select([0, 1]).take(pa.array(made[0] + at))
                    yield pa.RecordBatch.from_arrays([ids.column(0), ids.column(1), *made[1]], names=["id", "h", "line", "h1", "h2", "halves"])

    return docs.mapInArrow(found, "id bigint, h bigint, line bigint, h1 bigint, h2 bigint, halves array<bigint>")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.cast("binary").alias("text"))


def _sequences(chosen: DataFrame, units: int) -> DataFrame:
    """(id, h, line, kind, words) of the chosen lines of (id, h, text, lines): the line with single spaces; kind 1: its units are characters."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, kinds, own = [], [], [], []
            for row, (text, wanted) in enumerate(zip(batch.column(2), batch.column(3).to_pylist())):
                wanted = set(wanted)
                for number, words in _lines_of(text.as_py()):
                    if number in wanted:
                        rows.append(row)
                        numbers.append(number)
                        kinds.append(int(len(words) < units))
                        own.append(b" ".join(words))
            if rows:
                ids = batch.select([0, 1]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids.column(0), ids.column(1), pa.array(numbers, pa.int64()), pa.array(kinds, pa.int32()), pa.array(own, pa.binary())],
                                                 names=["id", "h", "line", "kind", "words"])

    return chosen.select("id", "h", "text", "lines").mapInArrow(found, "id bigint, h bigint, line bigint, kind int, words binary")


def _variants(sequences: DataFrame) -> DataFrame:
    """The whole line (gap -1) and each variant with one unit left out, as hashed keys."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                kinds, lines = part.column(3).to_pylist(), part.column(4).to_pylist()
                units = [_characters(_decoded(line)) if kind else word_digests(line.split(b" ")) for kind, line in zip(kinds, lines)]
                sizes = np.array([len(u) for u in units])
                last = np.cumsum(sizes)
                first = last - sizes
                # the whole line, then each unit of it
                row = np.repeat(np.arange(len(sizes)), sizes + 1)
                gap = np.arange(len(row)) - np.repeat(np.cumsum(sizes + 1) - sizes, sizes + 1)
                some, kind = gap >= 0, np.array(kinds, np.uint64)[row]
                keys = []
                for second in (False, True):
                    sums = _Sums(np.concatenate(units), second)
                    key = np.empty(len(row), np.uint64)
                    key[~some] = sums.part(first, last)
                    key[some] = sums.without(first[row[some]], last[row[some]], first[row[some]] + gap[some])
                    keys.append(pa.array((key & ~np.uint64(1) | kind).view(np.int64)))  # kinds differ in a bit of every key
                own = part.select([0, 1, 2]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(gap.astype(np.int32)), *keys], names=["id", "h", "line", "gap", "v1", "v2"])

    return sequences.mapInArrow(found, "id bigint, h bigint, line bigint, gap int, v1 bigint, v2 bigint")


def within_one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one unit inserted, deleted or replaced, or none, turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = min(len(a), len(b))
    differ = np.flatnonzero(a[:k] != b[:k])
    head = differ[0] if len(differ) else k
    differ = np.flatnonzero(a[::-1][:k] != b[::-1][:k])
    tail = differ[0] if len(differ) else k
    return head + tail >= max(len(a), len(b)) - 1


def _units(kind: int, line: bytes) -> np.ndarray:
    """The words or characters of a line themselves."""
    return np.array(list(_decoded(line)) if kind else line.split(b" "), object)


def _verified(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """The late lines whose witness is within the bound, by the words or characters of both."""
    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [k == j and within_one_edit(_units(k, x), _units(k, y)) for k, j, x, y in zip(*(batch.column(c).to_pylist() for c in (3, 4, 5, 6)))]
            yield batch.select([0, 1, 2]).filter(pa.array(same, pa.bool_()))

    named = lambda side: sequences.select(F.struct("id", "h", "line").alias(side), F.col("kind").alias(f"{side}_kind"), F.col("words").alias(f"{side}_words"))
    both = (pairs.select("late", "early").join(named("l"), F.col("late").eqNullSafe(F.col("l"))).join(named("e"), F.col("early").eqNullSafe(F.col("e"))))
    return both.select("late.*", "l_kind", "e_kind", "l_words", "e_words").mapInArrow(checked, "id bigint, h bigint, line bigint")


def _repeated(source: DataFrame, units: int) -> DataFrame:
    """(id, h, line) of every line that goes, of (id, h, text)."""
    lines = materialize(_lines(source, units), "lines")
    place = F.struct("id", "h", "line")
    firsts = materialize(lines.groupBy("h1", "h2").agg(
        F.min(place).alias("first"), F.first("halves").alias("halves")), "lines")
    turned = firsts.select(F.bitwise_not("h1").alias("key"), "h2", "first")
    equal = (lines.withColumn("key", F.bitwise_not("h1")).join(turned, ["key", "h2"])
             .filter(place > F.col("first")).select("id", "h", "line"))
    halves = firsts.select("first", F.explode(F.array_distinct("halves")).alias("half"))
    shared = halves.groupBy("half").agg(F.min("first").alias("low"), F.max("first").alias("high")).filter("low < high")
    chosen = (halves.withColumn("key", F.bitwise_not("half"))
              .join(shared.select(F.bitwise_not("half").alias("key")), "key", "left_semi").select("first").distinct()
              .select("first.*").groupBy(F.col("id").alias("own"), F.col("h").alias("own_h")).agg(F.collect_set("line").alias("lines")))
    wanted = source.join(chosen, F.col("id").eqNullSafe(F.col("own")) & (F.col("h") == F.col("own_h")))
    # rows that repeat id and text give the same lines
    sequences = materialize(_sequences(wanted, units).dropDuplicates(["id", "h", "line"]), "sequences")
    variants = materialize(_variants(sequences), "variants")
    earliest = (variants.filter("gap >= 0").groupBy("v1", "v2", "gap").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                .filter("first < last").select(F.bitwise_not("v1").alias("key"), "v2", "gap", "first"))
    replaced = (variants.filter("gap >= 0").withColumn("key", F.bitwise_not("v1")).join(earliest, ["key", "v2", "gap"])
                .select(place.alias("late"), F.col("first").alias("early")))
    whole = variants.filter("gap < 0").select(F.bitwise_not("v1").alias("key"), "v2", place.alias("whole"))
    shorter = variants.filter("gap >= 0").withColumn("key", F.bitwise_not("v1")).join(whole, ["key", "v2"]).select(place.alias("part"), "whole")
    deleted = shorter.select(F.greatest("part", "whole").alias("late"), F.least("part", "whole").alias("early"))
    witnesses = replaced.union(deleted).filter("early < late").groupBy("late").agg(F.min("early").alias("early"))
    near = _verified(materialize(witnesses, "witnesses"), sequences)
    return equal.union(near).distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: int = UNITS) -> DataFrame:
    """(id, h, line) of every line that goes; lines are numbered from 0 between line feeds.

    h is the hash of the text. Null ids come first, null and empty texts have no lines.
    """
    return _repeated(_source(docs, id_col, text_col), units)


def _gone(docs: DataFrame, id_col: str, text_col: str, units: int) -> DataFrame:
    """`docs` as a struct `record`, its text, and the sorted numbers of the lines that go, null without any."""
    gone = repeated_lines(docs, id_col, text_col, units).groupBy(F.col("id").alias("own"), F.col("h").alias("own_h")).agg(F.sort_array(F.collect_set("line")).alias("gone"))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col(id_col).cast("bigint").alias("id"),
                       F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.alias("text"))
    return rows.join(gone, F.col("id").eqNullSafe(F.col("own")) & (F.col("h") == F.col("own_h")), "left").select("record", "text", "gone")


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: int = UNITS) -> DataFrame:
    """One row per input row: id, n_lines, n_removed and the numbers of the lines that go."""
    rows = _gone(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col, units)
    removed = F.coalesce("gone", F.array().cast("array<bigint>"))
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("bigint")
    return rows.select(F.col("record")[id_col].alias(id_col), lines.alias("n_lines"), F.size(removed).cast("bigint").alias("n_removed"), removed.alias("removed"))


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    def left(text: str, numbers) -> str:
        lines = text.split("\n")
        for k in reversed(numbers.tolist()):
            del lines[k]
        return "\n".join(lines)

    return pd.Series([t if t is None or g is None else left(t, g) for t, g in zip(texts, gone)])


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: int = UNITS) -> DataFrame:
    """`docs` with the repeated lines taken out of their texts; null texts stay null."""
    rows = _gone(docs, id_col, text_col, units).withColumn("text", _without("text", "gone"))
    return rows.select(*[F.col("text").alias(c) if c == text_col else F.col("record")[c].alias(c) for c in docs.columns])


@finished
def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line, regexp_extract_all(unnest(ls), '[^\x20\x09-\x0D]+') AS words FROM d),
c AS (SELECT doc_id, line, len(words) < 8 AS short, words, array_to_string(words, ' ') AS joined FROM l WHERE len(words) > 0),
u AS (SELECT doc_id, line, struct_pack(d := doc_id, l := line) AS place, short,
             CASE WHEN short THEN list_transform(range(length(joined)), lambda k: substr(joined, k + 1, 1)) ELSE words END AS units FROM c),
f AS (SELECT short, units, len(units) AS n, min(place) AS first FROM u GROUP BY ALL),
v AS (SELECT short, n, first, gap, array_to_string(units[:gap - 1] || units[gap + 1:], chr(1)) AS variant
      FROM (SELECT *, unnest(range(1, n + 1)) AS gap FROM f WHERE n >= 8)),
near AS (
  SELECT first AS place FROM (SELECT first, min(first) OVER (PARTITION BY short, n, gap, variant) AS least FROM v) WHERE first > least
  UNION SELECT greatest(v.first, f.first) FROM v JOIN f ON v.short = f.short AND v.n = f.n + 1 AND v.variant = array_to_string(f.units, chr(1)) WHERE f.n >= 8
  UNION SELECT place FROM u JOIN f USING (short, units) WHERE place > first),
gone AS (SELECT place.d AS doc_id, count(*) AS n_removed, string_agg(place.l::VARCHAR, ',' ORDER BY place.l) AS removed FROM near GROUP BY 1)
SELECT doc_id, len(ls) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed FROM d LEFT JOIN gone USING (doc_id)
"""
