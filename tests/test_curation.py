"""Sources, schema, labels, policy and features."""

import datetime

import pytest
from pyspark.sql import functions as F

from credence.functions import coerce_numeric, parse_issue_date
from credence.operators.features import add_credit_utilization, add_dti, add_fico_band, add_loan_to_income, feature_matrix
from credence.operators.labels import closed_loans, default_target
from credence.operators.policy import exclude_leaky_columns, leakage_policy, post_origination_columns, select_origination_columns
from credence.operators.schema import alias_lookup, canonical_names, normalize_credit_schema
from credence.plans.job import curate
from credence.sources import load_loans, read_raw_loans, read_report_rows, write_curated


def test_dates(spark):
    given = {"Jan-2018": (2018, 1, 1), "jan-2018": (2018, 1, 1), "January-2018": (2018, 1, 1), " 2018-03-01 ": (2018, 3, 1), "2018-03": (2018, 3, 1),
             "3/4/2018": (2018, 3, 4), "25/4/2018": (2018, 4, 25), "20180304": (2018, 3, 4), "Dec-15": (2015, 12, 1), "12:30": None, "": None, "soon": None, None: None}
    rows = spark.createDataFrame([(k,) for k in given], "s string").select("s", parse_issue_date(F.col("s")).alias("d")).collect()
    for r in rows:
        want = given[r["s"]]
        assert r["d"] == (datetime.datetime(*want) if want else None), r
    moment = spark.createDataFrame([("2016-12-31 05:00",)], "s string").select(parse_issue_date(F.col("s"))).first()[0]
    assert moment == datetime.datetime(2016, 12, 31, 5)


def test_numbers(spark):
    given = {"47.5%": 47.5, " 12 ": 12.0, "1e3": 1000.0, ".5": 0.5, "12d": None, "12f": None, "1,000": None, "nan": None, "": None, "%": None, "inf": float("inf"), "-Infinity": float("-inf"), None: None}
    rows = spark.createDataFrame([(k,) for k in given], "s string").select("s", coerce_numeric(F.col("s")).alias("x")).collect()
    assert {r["s"]: r["x"] for r in rows} == given
    assert spark.createDataFrame([(float("nan"),)], "x double").select(coerce_numeric(F.col("x"))).first()[0] is None


def test_aliases():
    lookup = alias_lookup({"loan_status": "outcome", "mine": ["a", "b"]})
    assert lookup["outcome"] == "loan_status" and lookup["loanstatus"] == "loan_status" and lookup["a"] == lookup["mine"] == "mine"
    assert alias_lookup({"zip": ["term"]})["term"] == "zip"
    assert canonical_names(["status", "loan_status", "x", "X"]) == ["loan_status", None, "x", None]
    assert canonical_names(["loan_status", "status", "revolUtil"]) == ["loan_status", "status", "revol_util"]
    with pytest.raises(ValueError):
        alias_lookup(["status"])


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "loans.CSV"
    path.write_text("status,loan_amount,annual_income,debt_to_income,issue_month,x,x\r\nFully Paid,1,50000,NA,Jan-2018,1,2\r\nCurrent,2,n/a,3,Feb-2018,1,2\r\n charged OFF ,3,1,2.5,Mar-2018,,2\r\n")
    loans = load_loans(spark, str(path)).orderBy("loan_amnt").collect()
    assert [(r["loan_amnt"], r["dti"], r["issue_d"].date().isoformat()) for r in loans] == [("1", None, "2018-01-01"), ("3", "2.5", "2018-03-01")]
    assert loans[1]["x"] is None and loans[1]["x.1"] == "2"
    with pytest.raises(FileNotFoundError):
        read_raw_loans(spark, str(tmp_path / "none.csv"))
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError):
        read_raw_loans(spark, str(tmp_path / "a.txt"))
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    with pytest.raises(KeyError):
        load_loans(spark, str(tmp_path / "b.csv"))


def test_labels(spark):
    rows = spark.createDataFrame([("Fully Paid",), ("Charged Off",), (" DEFAULT ",), ("Current",), (None,), ("Does not meet the credit policy. Status:Fully Paid",)], "loan_status string")
    assert [r[0] for r in default_target(rows).select("default_flag").collect()] == [0, 1, 1, None, None, 0]
    assert closed_loans(rows).count() == 4
    assert closed_loans(rows, closed_statuses=[" current"]).count() == 1
    with pytest.raises(KeyError):
        default_target(rows, status_column="other")


def test_policy(spark):
    assert post_origination_columns(["loan_amnt", "loan_status", "total_pymnt", "annual_inc", "Total_Pymnt"]) == ["loan_status", "total_pymnt"]
    frame = spark.createDataFrame([("x", 1.0, 2.0, 1, "u")], "loan_status string, total_pymnt double, loan_amnt double, default_flag int, url string")
    assert exclude_leaky_columns(frame).columns == ["loan_amnt", "default_flag", "url"]
    assert "total_pymnt" in exclude_leaky_columns(frame, keep_columns=["total_pymnt"]).columns
    assert select_origination_columns(frame).columns == ["default_flag", "loan_amnt"]
    table = leakage_policy(spark).collect()
    assert len(table) == 45 and sum(r["available_at_origination"] for r in table) == 26 and table[26]["column"] == "loan_status"


def test_features(spark):
    one = lambda schema, row, add, column: spark.createDataFrame([row], schema).transform(add).first()[column]
    assert one("loan_amnt double, annual_inc double", (10000.0, 50000.0), add_loan_to_income, "loan_to_income_ratio") == 0.2
    assert one("loan_amnt double, annual_inc double", (10000.0, 0.0), add_loan_to_income, "loan_to_income_ratio") is None
    assert one("revol_util string", ("47.5%",), add_credit_utilization, "credit_utilization") == pytest.approx(0.475)
    assert one("total_credit_utilized double, total_credit_limit double", (2500.0, 10000.0), add_credit_utilization, "credit_utilization") == 0.25
    assert one("dti string", ("n/a",), add_dti, "dti_clean") is None
    for low, high, band in ((700, 704, "good"), (578, 581, "poor"), (579, 581, "fair"), (670, 670, "good"), (740, 740, "very_good"), (800, 800, "exceptional"), (-5, -5, None), (None, 4, None)):
        assert one("fico_range_low int, fico_range_high int", (low, high), add_fico_band, "fico_band") == band
    base = "dti double, revol_util string, loan_amnt double, annual_inc double"
    plain = spark.createDataFrame([(1.0, "20%", 1.0, 2.0)], base)
    assert "fico_band" not in feature_matrix(plain).columns and "revol_util" in feature_matrix(plain).columns
    with pytest.raises(KeyError):
        feature_matrix(plain.withColumn("fico_range_low", F.lit(1)))
    with pytest.raises(KeyError):
        add_credit_utilization(plain.drop("revol_util"))


def test_curation_moves_nothing(spark, tmp_path):
    raw = spark.createDataFrame([("Fully Paid", "Jan-2016", 1.0, 2.0, "3", "20%", "u"), ("Charged Off", "Feb-2017", 1.0, 2.0, "3", "20%", "u")],
                                "status string, issue_month string, loan_amount double, annual_income double, dti string, revolUtil string, url string")
    features = curate(closed_loans(normalize_credit_schema(raw)))
    assert "Exchange" not in features._jdf.queryExecution().executedPlan().toString()
    assert "url" not in features.columns and "loan_status" not in features.columns
    write_curated(features, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("issue_year = 2017").count() == 1


def test_stream(spark, tmp_path):
    from credence.streaming import curate_stream

    schema = "status string, issue_month string, loan_amount double, annual_income double, dti string, revolUtil string"
    spark.createDataFrame([("Fully Paid", "Jan-2016", 1.0, 2.0, "3", "20%"), ("Current", "Jan-2016", 1.0, 2.0, "3", "20%")], schema).write.parquet(str(tmp_path / "in"))
    query = curate_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("curated").start()
    try:
        query.processAllAvailable()
        assert spark.table("curated").count() == 1
    finally:
        query.stop()


def test_reports_skip_rows_that_are_not_finite(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\nNaN,1\nInfinity,3\n,4\n")
    assert read_report_rows(spark, str(tmp_path / "t.csv"), "a double, b double").count() == 1


def test_numbers_are_not_read_from_text_again(spark):
    """Columns of numbers give what their texts give, without a pattern over them; a date's text is made once."""
    from credence.functions import coerced

    rows = spark.sql("SELECT * FROM VALUES (1, 2L, 1.5D, 0.1F, 1.10BD, ' 7% ', true), (null, null, double('NaN'), float('NaN'), null, '1,000', null), "
                     "(-3, 9007199254740993L, double('-Infinity'), float('Infinity'), -0.07BD, '12d', false) AS t(i, l, d, f, m, s, b)")
    found = rows.select(*[coerced(rows, c).alias(c) for c in rows.columns], *[coerce_numeric(F.col(c)).alias(f"_{c}") for c in rows.columns]).collect()
    assert all(r[c] == r[f"_{c}"] for r in found for c in rows.columns)
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan(rows.select(*[coerced(rows, c) for c in "ildm"]))
    made = spark.range(3).select(parse_issue_date(F.date_format(F.timestamp_seconds("id"), "MMM-yyyy")).alias("x"))
    assert plan(made).count("date_format") == 1
