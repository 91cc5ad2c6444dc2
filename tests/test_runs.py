"""Runs that are started again, folders in which files land, curated years that are replaced and pruned."""

import re
import shutil

import pytest
from pyspark.sql import functions as F

from credence.operators.split import time_split
from credence.plans import job
from credence.plans.stages import Stages, input_files, newest_stage
from credence.sources import read_curated, write_curated
from credence.streaming import landing

DATES = {"train_end_date": "2016-12-31", "test_start_date": "2017-01-01"}
HEAD = "status,issue_month,loan_amount,annual_income,debt_to_income,revolUtil,grade,desc"
ROWS = [f'{"Fully Paid" if k % 2 else "Charged Off"},{"Jan" if k % 3 else "Feb"}-{2016 + (k >= 12)},{1000 + 37 * k},{50000 + k},{10 + k},20%,{"AB"[k % 2]},"said ""a, b""\nline {k}"' for k in range(24)]


def _land(path, rows=ROWS, head=HEAD):
    path.write_text("\n".join([head, *rows]) + "\n")
    return str(path)


def test_a_run_goes_on_after_the_fit(spark, tmp_path, monkeypatch):
    path, out = _land(tmp_path / "a.csv"), str(tmp_path / "out")
    fits = []
    fit = job.train_model
    monkeypatch.setattr(job, "train_model", lambda *a, **k: fits.append(1) or fit(*a, **k))

    def killed(*args, **options):
        raise RuntimeError("the driver is lost")

    with monkeypatch.context() as m:
        m.setattr(job, "score", killed)
        with pytest.raises(RuntimeError, match="lost"):
            job.run_baseline(spark, path, output_dir=out, **DATES)
    assert len(fits) == 1 and newest_stage(spark, f"{out}/stages", "model")
    with pytest.raises(FileNotFoundError):
        newest_stage(spark, f"{out}/stages", "scores")
    with monkeypatch.context() as m:
        m.setattr(job, "curate", killed)
        first = job.run_baseline(spark, path, output_dir=out, **DATES)
        assert len(fits) == 1 and job.run_baseline(spark, path, output_dir=out, **DATES) == first and len(fits) == 1
    scores = newest_stage(spark, f"{out}/stages", "scores")
    job.run_baseline(spark, path, output_dir=out, model_config={"C": 0.1}, **DATES)  # another model: the curated table stays
    assert len(fits) == 2 and newest_stage(spark, f"{out}/stages", "scores") != scores
    _land(tmp_path / "a.csv", ROWS + ROWS[:2])
    job.run_baseline(spark, path, output_dir=out, **DATES)
    assert len(fits) == 3 and len([f for f in input_files(spark, f"{out}/stages") if re.search(r"curated-\w+\.json$", f[0])]) == 2


def test_a_stage_without_its_mark_is_made_anew(spark, tmp_path):
    made = []

    def make(path):
        made.append(path)
        spark.range(len(made)).write.parquet(path)

    stages = lambda: Stages(spark, str(tmp_path), [["in", 1, 2]])
    path = stages().stage("rows", make, {"a": 1})
    assert stages().stage("rows", make, {"a": 1}) == path and len(made) == 1
    (tmp_path / (path.rpartition("/")[2] + ".json")).unlink()  # lost before the mark was written
    assert stages().stage("rows", make, {"a": 1}) == path and len(made) == 2 and spark.read.parquet(path).count() == 2
    assert stages().stage("rows", make, {"a": 2}) != path and stages().made == []


def test_landing_folder(spark, tmp_path):
    folder, table, checkpoint = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "checkpoint")
    folder.mkdir()
    _land(folder / "1.csv", [*ROWS[:12], "too,few", "one,too,many,a,b,c,d,e,f"])
    _land(folder / "2.csv", ["x"], head="nothing")
    (folder / "3.csv").write_text('a,b\n1,"open\n')
    (folder / "notes.txt").write_text("no loans")
    options = {"output_dir": str(tmp_path / "out"), **DATES}
    landing.take_in_folder(spark, str(folder), table, checkpoint)
    loans = lambda: spark.read.option("mergeSchema", True).parquet(f"{table}/loans.parquet")
    rejects = lambda: sorted(r["reason"] for r in spark.read.parquet(f"{table}/rejects.parquet").collect())
    assert loans().count() == 12 and rejects() == ["file", "header", "record", "record"]
    assert {r["desc"] for r in loans().collect()} == {f'said "a, b"\nline {k}' for k in range(12)}
    # the same contents under another name, with other line ends, and a file that is taken in again count once
    (folder / "4.csv").write_bytes((folder / "1.csv").read_bytes())
    landing.take_in_folder(spark, str(folder), table, checkpoint)
    landing.take_in(spark, str(folder / "1.csv"), table)
    assert loans().count() == 12 and len(rejects()) == 4
    # further loans, with other columns
    (folder / "sub").mkdir()
    _land(folder / "sub" / "5.csv", [r.replace("\n", " ") for r in ROWS[12:]], head=HEAD.replace("desc", "title"))
    found = landing.refresh_from_folder(spark, str(folder), table, checkpoint, **options)
    assert loans().count() == 24 and {"desc", "title"} <= set(loans().columns)
    shutil.copy(folder / "1.csv", folder / "6.csv")
    assert landing.refresh_from_folder(spark, str(folder), table, checkpoint, **options) == found


def test_curated_years_are_replaced_and_pruned(spark, tmp_path):
    rows = spark.range(400).select(F.date_add(F.lit("2014-01-01"), (F.col("id") * 7 % 1800).cast("int")).cast("timestamp_ntz").alias("issue_d"), (F.col("id") % 2).cast("int").alias("default_flag"), F.col("id").alias("x"))
    path = str(tmp_path / "curated")
    write_curated(rows.repartition(5), path, rows_per_file=50)
    files = lambda: {f[0] for f in input_files(spark, path) if f[0].endswith(".parquet")}
    before = files()
    for f in before:  # bounded and in order of the date
        held = [r["issue_d"] for r in spark.read.parquet(f).collect()]
        assert len(held) <= 50 and held == sorted(held)
    write_curated(rows.filter(F.year("issue_d") == 2016).withColumn("x", F.lit(-1).cast("long")), path, replace_years=True)
    assert {f for f in before ^ files() if "issue_year=2016" not in f} == set() and {f for f in files() if "issue_year=2016" in f}.isdisjoint(before)
    curated = read_curated(spark, path)
    assert curated.count() == 400 and curated.filter("x = -1").count() == rows.filter(F.year("issue_d") == 2016).count()
    pruned = time_split(curated, date_column="issue_d", year_column="issue_year", **DATES)
    plain = time_split(curated.drop("issue_year"), date_column="issue_d", **DATES)
    for a, b in zip(pruned, plain):
        assert a.columns == b.columns == ["default_flag", "x"] and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
        kept = re.search(r"PartitionFilters: \[(.*?)\]", a._jdf.queryExecution().executedPlan().toString())[1]
        assert "issue_year" in kept
    assert len(pruned.train.inputFiles()) and {re.search(r"issue_year=(\d+)", r[0])[1] for r in pruned.test.select(F.col("_metadata.file_path")).distinct().collect()} == {"2017", "2018"}


def test_equal_files_of_a_batch_are_taken_in_once(spark, tmp_path, monkeypatch):
    from credence.streaming import landing

    folder, table = tmp_path / "in", tmp_path / "table"
    folder.mkdir()
    for name, last in (("a", 1), ("b", 1), ("c", 2), ("d", 3)):
        (folder / f"{name}.csv").write_text(f"loan_id,loan_status\n{last},Current\n")
    seen, take_in = [], landing.take_in
    monkeypatch.setattr(landing, "take_in", lambda spark, path, *rest, **options: (seen.append(path[-5:]), take_in(spark, path, *rest, **options)))
    landing.take_in_folder(spark, str(folder), str(table), str(tmp_path / "checkpoint"))
    assert sorted(seen) == ["b.csv", "c.csv", "d.csv"]
    assert sorted(r["loan_id"] for r in spark.read.parquet(f"{table}/loans.parquet").collect()) == ["1", "2", "3"]
