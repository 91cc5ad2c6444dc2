"""CSV records out of files that stay splittable, line breaks in quoted fields included.

Whether a line break ends a record depends on whether a quoted field is open there, and that
on all of the file before it. Spark reads a file in ranges of whole lines; a range starts
either between records or within a quoted field, so each range reports in one pass how it
ends for either start. These pairs, one row per range, are composed in the order of each
file, and then every range knows its start and cuts its own records. What is cut by the
ranges' borders, a piece or two for each range, is put together by a grouping.

A quote opens a field only as its first character; a doubled one within a quoted field is a
quote; what follows a closing quote up to the next comma belongs to the field as it stands,
and a quote elsewhere is a character like any other. Backslashes mean nothing. Records end at
LF, CRLF or CR; blank ones are left out.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: From the first character of a quoted field on up to its closing quote.
_CLOSING = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
_NEXT = re.compile(r"[,\r]")
#: Whole fields with what separates them from the next one.
_FIELDS = re.compile(r'(?:(?:"[^"]*+(?:""[^"]*+)*+"|(?!"))[^,\r]*+[,\r])*+')
#: Up to so many ranges are composed, and their starts sent to all tasks: 128 TB in ranges of 128 MB.
MOST_RANGES = 1 << 20


def open_after(line: str, opened: bool = False) -> bool:
    """Whether a quoted field is open at the end of a line; `opened`: one was at its start."""
    if opened:
        closed = _CLOSING.match(line)
        if not closed:
            return True
        rest = _NEXT.search(line, closed.end())
        if not rest:
            return False
        at = rest.end()
    else:  # no field before that of the first quote is a quoted one
        quote = line.find('"')
        if quote < 0:
            return False
        at = max(line.rfind(",", 0, quote), line.rfind("\r", 0, quote)) + 1
    at = _FIELDS.match(line, at).end()
    return line[at : at + 1] == '"' and not _CLOSING.match(line, at + 1)


def split_records(text: str) -> Iterator[list[str]]:
    """The records of a text that has whole ones only."""
    csv.field_size_limit(sys.maxsize)
    for record in csv.reader(io.StringIO(text, newline="")):
        if record and not (len(record) == 1 and record[0] and not record[0].strip(" \t")):
            yield record


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line): the lines of each range in their order; `start` names the range of a file."""
    line, start = F.col("value"), F.col("_metadata.file_block_start")
    mark = (start == 0) & line.startswith("\ufeff")
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), start.alias("start"), F.when(mark, F.substring(line, 2, 2**31 - 1)).otherwise(line).alias("line"))


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array, bool]]:
    """(range, lines, whether they are its first ones) for what of each batch lies in one range."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start, lines = batch.columns
        changed = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(start[1:], start[:-1]))
        cuts = [0, *(pc.indices_nonzero(changed).to_numpy() + 1).tolist()]
        for at, until in zip(cuts, [*cuts[1:], batch.num_rows]):
            own = (file[at].as_py(), start[at].as_py())
            yield own, lines[at:until], own != last
            last = own


def _with_quotes(lines: pa.Array) -> list[tuple[int, str]]:
    """The places of the lines with quotes, and these lines."""
    places = pc.indices_nonzero(pc.match_substring(lines, '"'))
    return list(zip(places.to_pylist(), lines.take(places).to_pylist()))


class _Header:
    """The first record of a file, from its lines in turn."""

    def __init__(self):
        self.lines: list[str] = []
        self.opened = False
        self.fields: list[str] | None = None

    def take(self, lines: pa.Array) -> None:
        for k in range(len(lines)):
            if self.fields is not None:
                return
            self.lines.append(lines[k].as_py())
            self.opened = open_after(self.lines[-1], self.opened)
            if not self.opened:
                self.fields = next(split_records("\n".join(self.lines)), None)


_RANGE = "file string, start bigint, after_closed boolean, after_open boolean, began boolean, header array<string>"


def _ranges(lines: DataFrame) -> DataFrame:
    """One row per range: for either start whether a field is open at its end; whether a record begins
    in it although it starts within a field; and of the first range of a file the header."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = states = header = None
        began = False

        def row() -> pa.RecordBatch:
            values = [own[0], own[1], states[0], states[1], began, header.fields if header else None]
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["file", "start", "after_closed", "after_open", "began", "header"])

        for now, part, fresh in _parts(batches):
            if fresh:
                if own:
                    yield row()
                own, states, began = now, (False, True), False
                header = _Header() if now[1] == 0 else None
                closed = False  # whether the field that was open at the start has ended
            if header:
                header.take(part)
            began = began or closed
            for k, line in _with_quotes(part):
                after = open_after(line, states[0])
                states = (after, after if states[0] == states[1] else open_after(line, states[1]))
                if not closed and not states[1]:
                    closed = True
                    began = began or k + 1 < len(part)
        if own:
            yield row()

    return lines.mapInArrow(made, _RANGE)


@dataclass(frozen=True)
class _Layout:
    """How the ranges of a table's files start: the range where the record began that is open there, or None."""

    origins: dict[tuple[str, int], int | None]
    header: list[str]
    cut: list[str]  # the files of which a range starts within a field


def _composed(ranges: Iterable) -> _Layout:
    """The ranges' reports, composed in the order of each file."""
    origins: dict[tuple[str, int], int | None] = {}
    headers: dict[str, list[str]] = {}
    cut: set[str] = set()
    file, opened, origin = None, False, None

    def end() -> None:
        if opened:
            raise ValueError(f"A quoted field is not closed at the end of {file}.")

    for r in sorted(ranges, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            end()
            file, opened, origin = r["file"], False, None
        origins[file, r["start"]] = origin if opened else None
        if r["header"] is not None:
            headers[file] = list(r["header"])
        if opened:
            cut.add(file)
        if not opened or r["began"]:
            origin = r["start"]
        opened = r["after_open"] if opened else r["after_closed"]
    end()
    if len({tuple(h) for h in headers.values()}) > 1:
        raise ValueError("The files of a table must have one header.")
    return _Layout(origins, next(iter(headers.values()), []), sorted(cut))


def _cut(lines: DataFrame, origins: dict, pieces: bool) -> DataFrame:
    """The records that lie within a range, or, with `pieces`, the lines of those that do not.

    A record (head, fields): head says that it is the first of its file. A piece
    (file, origin, start, head, piece): of the record that began in the range `origin`.
    """
    sent = lines.sparkSession.sparkContext.broadcast(origins)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, opened, origin, first = None, [], False, None, False

        def batch(rows: list[list]) -> pa.RecordBatch:
            nonlocal first
            if pieces:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
                return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["file", "origin", "start", "head", "piece"])
            heads = [False] * len(rows)
            if rows:
                heads[0], first = first, False
            return pa.RecordBatch.from_arrays([pa.array(heads, pa.bool_()), pa.array(rows, pa.list_(pa.string()))], names=["head", "fields"])

        def taken(whole: list[str]) -> Iterator[pa.RecordBatch]:
            """The batches of whole records."""
            nonlocal first
            if not pieces:
                rows = list(split_records("\n".join(whole))) if whole else []
                for at in range(0, len(rows), 5000):
                    yield batch(rows[at : at + 5000])
            elif first and next(split_records("\n".join(whole)), None):
                first = False

        def border() -> Iterator[pa.RecordBatch]:
            """The piece of a record that began before or goes on after."""
            nonlocal first
            if pieces and held:
                yield batch([[own[0], own[1] if origin is None else origin, own[1], first and origin is None, "\n".join(held)]])

        for now, part, fresh in _parts(batches):
            if fresh:
                yield from border()
                own, held, first = now, [], now[1] == 0
                if now not in sent.value:
                    raise RuntimeError("The files are dealt to other ranges than when the table was read: spark.sql.files settings, the cores or the files have changed. Read it again.")
                origin = sent.value[now]
                opened = origin is not None
            texts, done, whole = part.to_pylist(), 0, []
            for k, line in _with_quotes(part):
                after = open_after(line, opened)
                if opened and not after:  # the record that is open ends in this line
                    held += texts[done : k + 1]
                    if origin is None:
                        whole += held
                    else:
                        yield from border()
                        origin = None
                    held, done = [], k + 1
                elif after and not opened:
                    whole += texts[done:k]
                    held, done = [line], k + 1
                opened = after
            if opened:
                held += texts[done:]
            else:
                whole += texts[done:]
            yield from taken(whole)
        yield from border()

    return lines.mapInArrow(made, "file string, origin bigint, start bigint, head boolean, piece string" if pieces else "head boolean, fields array<string>")


def _joined(pieces: DataFrame) -> DataFrame:
    """The records that were cut by borders of ranges."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [next(split_records(text.as_py()), []) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], names=["head", "fields"])

    whole = pieces.groupBy("file", "origin").agg(F.bool_or("head").alias("head"), F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("pieces"))
    return whole.select("head", F.array_join(F.transform("pieces", lambda p: p["piece"]), "\n").alias("text")).mapInArrow(made, "head boolean, fields array<string>")


def read_records(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The header of a CSV file, or of a folder of such files with one header, and its records as `fields`.

    One pass over the files finds how their ranges start; the records are read when they are
    asked for, with as many tasks as the files have ranges. Only if a border cuts a record are they
    read again, and the lines of the files that have such a one searched for the pieces. Raises ValueError for a quoted field that is
    never closed and for files whose headers differ; a table without lines has an empty header.
    """
    lines = _lines(spark, path)
    found = _ranges(lines).limit(MOST_RANGES + 1).collect()  # a row per range
    if len(found) > MOST_RANGES:
        raise ValueError(f"The files have more than {MOST_RANGES} ranges; a larger spark.sql.files.maxPartitionBytes makes fewer.")
    layout = _composed(found)
    records = _cut(lines, layout.origins, pieces=False)
    if layout.cut:
        # a filter on the file alone would drop files before Spark deals them, and the size of ranges hangs on all of them
        cut = lines.filter(F.col("file").isin(layout.cut) | F.col("line").isNull()) if len(layout.cut) <= 1000 else lines
        records = records.union(_joined(_cut(cut, layout.origins, pieces=True)))
    return layout.header, records.filter("NOT head").select("fields")
