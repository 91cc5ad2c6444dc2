"""CSV records across ranges of a file, against Python's reader of whole files and DuckDB's."""

import csv
import io
import random

import duckdb
import pytest

from credence.sources.delimited import _composed, open_after, split_records
from credence.sources.loans import load_loans, read_csv

RECORDS = [["id", "desc", "loan_status"], ["1", "line one\nline two, more", "Fully Paid"], ["2", 'he said "pay, now" ok', "Charged Off"], ["3", "ends with \\", "Default"],
           ["4", "a\r\n\r\n\"b\"", "Fully Paid"], ["5", "plain", "Charged Off"]]


def _write(path, records, **how):
    out = io.StringIO(newline="")
    csv.writer(out, **{"lineterminator": "\n"} | how).writerows(records)
    path.write_bytes(out.getvalue().encode())
    return str(path)


def _rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_quotes_line_breaks_and_backslashes(spark, tmp_path):
    for k, how in enumerate(({}, {"lineterminator": "\r\n"}, {"quoting": csv.QUOTE_ALL})):
        path = _write(tmp_path / f"{k}.csv", RECORDS, **how)
        assert _rows(read_csv(spark, path)) == sorted(map(tuple, RECORDS[1:]))
        assert read_csv(spark, path).columns == RECORDS[0]
        assert load_loans(spark, path).count() == 5
        assert sorted(duckdb.sql(f"SELECT * FROM read_csv('{path}', header = true, all_varchar = true, quote = '\"', escape = '\"')").fetchall()) == _rows(read_csv(spark, path))


@pytest.mark.parametrize("seed", range(2))
def test_many_ranges_of_one_file(spark, tmp_path, seed):
    """Records that lie across ranges, and ranges that lie within a record, in files of several tasks."""
    rng = random.Random(seed)
    texts = ["a", "", "x,y", 'q"q', "\n", 'line\n"two"\n\n', "\\", "é\n" * 50, "long\n" * 3000, '"\n' * 700, "w" * 9000]
    records = [["id", "a\nb", "c"]] + [[str(k), rng.choice(texts), rng.choice(texts)] for k in range(400)]
    path = _write(tmp_path / "many.csv", records)
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        frame = read_csv(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 50 and frame.columns == records[0]
        assert _rows(frame.fillna("")) == sorted(map(tuple, records[1:]))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9001")  # a frame that was read before finds other ranges
        with pytest.raises(Exception, match="Read it again"):
            frame.count()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_folder_with_cut_and_whole_files(spark, tmp_path):
    """Files of which only some have a record across ranges; the size of the ranges hangs on all files."""
    folder = tmp_path / "some.csv"
    folder.mkdir()
    broken = [[str(k), "line one\nline two\n" * 40] for k in range(300)]
    plain = [[str(k), "x" * 100] for k in range(1000, 3000)]
    _write(folder / "1.csv", [["id", "desc"], *broken])
    _write(folder / "2.csv", [["id", "desc"], *plain])
    held = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert _rows(read_csv(spark, str(folder))) == sorted(map(tuple, broken + plain))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", held)


def test_odd_files(spark, tmp_path):
    odd = tmp_path / "odd.csv"
    odd.write_bytes(b'\xef\xbb\xbf"a, b",c,c\n\n1,5" pipe,"x"y"z\n  \n2\n3,4,5,6\n"",NA, "q"\n')
    frame = read_csv(spark, str(odd))
    assert frame.columns == ["a, b", "c", "c.1"]
    assert sorted(frame.collect(), key=str) == sorted([("1", '5" pipe', 'xy"z'), ("2", None, None), ("3", "4", "5"), (None, None, ' "q"')], key=str)
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        read_csv(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "open.csv").write_text('a,b\n1,"never closed\n2,3\n')
    with pytest.raises(ValueError, match="not closed"):
        read_csv(spark, str(tmp_path / "open.csv"))
    folder = tmp_path / "folder.csv"
    folder.mkdir()
    (folder / "1.csv").write_text('a,b\n1,"x\ny"\n')
    (folder / "2.csv").write_text("a,b\n2,z\n")
    assert _rows(read_csv(spark, str(folder))) == [("1", "x\ny"), ("2", "z")]
    (folder / "3.csv").write_text("b,a\n")
    with pytest.raises(ValueError, match="one header"):
        read_csv(spark, str(folder))


def test_open_after_against_the_reader():
    """A line leaves a field open just if the reader takes a further line into its record."""
    rng = random.Random(7)
    for _ in range(3000):
        line = "".join(rng.choices('"",a ', k=rng.randint(0, 12)))
        for opened in (False, True):
            text = ('"' if opened else "") + line + "\nz"
            records = list(csv.reader(io.StringIO(text, newline="")))
            assert open_after(line, opened) == (records[-1] != ["z"]), (line, opened)
    assert list(split_records("\n\n \na\n")) == [["a"]]


def test_composition_of_ranges():
    report = lambda start, closed, opened, began, header=None: {"file": "f", "start": start, "after_closed": closed, "after_open": opened, "began": began, "header": header}
    layout = _composed([report(30, True, True, True), report(0, True, False, True, ["a"]), report(10, False, True, False), report(20, True, False, True), report(40, False, False, False)])
    assert layout.origins == {("f", 0): None, ("f", 10): 0, ("f", 20): 0, ("f", 30): None, ("f", 40): 30} and layout.cut == ["f"] and layout.header == ["a"]
