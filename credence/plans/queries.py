"""One query per operator over the driver's tables, each with the SQL that it must equal."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions import coerce_numeric, parse_issue_date
from credence.operators import calibration, evaluation, models, policy, preprocess, split
from credence.operators.features import add_credit_utilization, add_dti, add_fico_band, add_loan_to_income, feature_matrix
from credence.operators.labels import closed_loans, default_target
from credence.operators.schema import normalize_credit_schema
from credence.plans import job
from credence.plans.job import curate
from credence.plans.loan_view import LOANS_SQL, RAW_SQL, SCORED, SCORED_SQL, TEST_START, TRAIN_END, raw_loans
from credence.plans.stages import input_files, newest_stage
from credence.sources import load_loans, read_curated, read_metrics, read_raw_loans, read_report_rows, write_curated, write_reports
from credence.sources.reports import CALIBRATION_SCHEMA, THRESHOLD_SCHEMA
from credence.sources.storage import shared_folder
from credence.streaming import curate_stream, landing

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(name: str, sql: str | None = None):
    def add(make):
        QUERIES[name] = make
        if sql:
            ORACLE_SQL[name] = sql
        return make

    return add


def _rounded(rows: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a number of places that does not depend on the order of additions."""
    return rows.select([F.round(F.col(n), places).alias(n) if kind == "double" else F.col(n) for n, kind in rows.dtypes])


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_credit_schema(raw_loans(spark, sf_dir))


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closed_loans(_loans(spark, sf_dir))


# ---------------------------------------------------------------- schema, labels, policy


@_query("normalize_schema", f"""WITH {RAW_SQL} SELECT loan_id, trim(status) AS loan_status, strftime(issue_d, '%Y-%m-%d') AS issue_d, round(loan_amnt, 6) AS loan_amnt,
  round(annual_inc, 6) AS annual_inc, dti, revol_util, home_ownership, addr_state, url FROM raw""")
def normalize_schema(spark, sf_dir):
    return _rounded(_loans(spark, sf_dir).select("loan_id", F.trim("loan_status").alias("loan_status"), F.date_format("issue_d", "yyyy-MM-dd").alias("issue_d"),
                                                 "loan_amnt", "annual_inc", "dti", "revol_util", "home_ownership", "addr_state", "url"))


@_query("normalize_issue_date", f"WITH {RAW_SQL} SELECT strftime(issue_d, '%Y-%m-%d %H:%M') AS issued, count(*) AS loans FROM raw GROUP BY ALL")
def normalize_issue_date(spark, sf_dir):
    date = parse_issue_date(F.col("issue_month"))
    return raw_loans(spark, sf_dir).groupBy(F.date_format(date, "yyyy-MM-dd HH:mm").alias("issued")).agg(F.count(F.lit(1)).alias("loans"))


@_query("coerce_numeric", f"""WITH {RAW_SQL} SELECT loan_id, CASE WHEN dti <> 'n/a' THEN CAST(dti AS DOUBLE) END AS dti,
  CAST(replace(revol_util, '%', '') AS DOUBLE) AS revol_util FROM raw""")
def coerce_numbers(spark, sf_dir):
    return raw_loans(spark, sf_dir).select("loan_id", coerce_numeric(F.col("debt_to_income")).alias("dti"), coerce_numeric(F.col("revolUtil")).alias("revol_util"))


@_query("closed_loans", f"WITH {LOANS_SQL} SELECT loan_id, lower(status) AS status FROM closed")
def closed(spark, sf_dir):
    return _closed(spark, sf_dir).select("loan_id", F.lower(F.trim("loan_status")).alias("status"))


@_query("default_target", f"""WITH {RAW_SQL} SELECT loan_id, CAST(CASE WHEN status = 'Current' THEN NULL WHEN status LIKE '%Fully Paid' THEN 0 ELSE 1 END AS INT) AS default_flag FROM raw""")
def target(spark, sf_dir):
    return default_target(_loans(spark, sf_dir)).select("loan_id", "default_flag")


_POLICY_VALUES = ", ".join([f"('{c}', true, '{policy.ORIGINATION_REASON}')" for c in policy.ORIGINATION_COLUMNS]
                           + [f"('{c}', false, '{r}')" for c, r in policy.POST_ORIGINATION_COLUMNS.items()])
_PROFILED = ("loan_status", "issue_d", "loan_amnt", "annual_inc", "dti", "revol_util", "total_credit_utilized", "total_credit_limit", "fico_range_low",
             "fico_range_high", "term", "grade", "home_ownership", "addr_state", "total_pymnt", "recoveries")


@_query("leakage_policy", f"""WITH {RAW_SQL}, policy(name, available_at_origination, reason) AS (VALUES {_POLICY_VALUES}),
  filled AS (SELECT unnest([{', '.join(f"'{c}'" for c in _PROFILED)}]) AS name, unnest([{', '.join(f'count({"status" if c == "loan_status" else c})' for c in _PROFILED)}]) AS filled FROM raw)
  SELECT policy.name AS "column", available_at_origination, reason, coalesce(filled, 0) AS filled FROM policy LEFT JOIN filled USING (name)""")
def leakage_policy(spark, sf_dir):
    """The policy, and how many raw loans have a value in each of its columns."""
    loans = _loans(spark, sf_dir)
    there = [c for c in loans.columns if c in policy.ORIGINATION_COLUMNS or c in policy.POST_ORIGINATION_COLUMNS]
    filled = loans.agg(*[F.count(c).alias(c) for c in there]).select(F.explode(F.create_map(*[x for c in there for x in (F.lit(c), F.col(c))])).alias("column", "filled"))
    return policy.leakage_policy(spark).join(filled, "column", "left").withColumn("filled", F.coalesce("filled", F.lit(0)))


_LEFT = ("loan_id", "loan_amnt", "annual_inc", "dti", "revol_util", "total_credit_utilized", "total_credit_limit", "fico_range_low", "fico_range_high", "term",
         "grade", "home_ownership", "addr_state", "url", "desc", "default_flag")


@_query("exclude_leaky", f"""WITH {LOANS_SQL} SELECT {", ".join(f'"{c}"' for c in _LEFT if c not in ("loan_amnt", "annual_inc"))}, {_r("loan_amnt", "annual_inc")},
  strftime(issue_d, '%Y-%m-%d') AS issue_d FROM closed""")
def exclude_leaky(spark, sf_dir):
    left = policy.exclude_leaky_columns(default_target(_closed(spark, sf_dir)))
    return _rounded(left.withColumn("issue_d", F.date_format("issue_d", "yyyy-MM-dd")))


@_query("select_origination", f"""WITH {LOANS_SQL} SELECT {", ".join(c for c in _LEFT if c not in ("loan_amnt", "annual_inc", "loan_id", "url", "desc"))},
  {_r("loan_amnt", "annual_inc")}, strftime(issue_d, '%Y-%m-%d') AS issue_d FROM closed""")
def select_origination(spark, sf_dir):
    kept = policy.select_origination_columns(default_target(_closed(spark, sf_dir)))
    return _rounded(kept.withColumn("issue_d", F.date_format("issue_d", "yyyy-MM-dd")))


# ---------------------------------------------------------------- features


def _feature(name: str, columns: tuple[str, ...], add, drop: tuple[str, ...] = (), sql: str | None = None):
    sql = sql or f"WITH {LOANS_SQL} SELECT loan_id, {', '.join(c if c == 'fico_band' else f'round({c}, 6) AS {c}' for c in columns)} FROM loans"
    _query(name, sql)(lambda spark, sf_dir: _rounded(add(_closed(spark, sf_dir).drop(*drop)).select("loan_id", *columns)))


_feature("dti_clean", ("dti_clean",), add_dti)
_feature("credit_utilization", ("credit_utilization",), add_credit_utilization)
_feature("credit_utilization_totals", ("credit_utilization",), add_credit_utilization, ("revol_util",),
         f"WITH {LOANS_SQL} SELECT loan_id, round(total_credit_utilized / nullif(total_credit_limit, 0), 6) AS credit_utilization FROM closed")
_feature("fico_band", ("fico_midpoint", "fico_band"), add_fico_band)
_feature("loan_to_income", ("loan_to_income_ratio",), add_loan_to_income)
_feature("feature_matrix", ("dti_clean", "credit_utilization", "fico_midpoint", "fico_band", "loan_to_income_ratio"), feature_matrix)


@_query("default_rate_by_band", f"""WITH {LOANS_SQL} SELECT fico_band, grade, count(*) AS loans, sum(default_flag)::BIGINT AS defaults,
  round(avg(default_flag), 6) AS default_rate FROM loans GROUP BY ALL""")
def default_rate_by_band(spark, sf_dir):
    """The flagship: curated loans to default rates by score band and grade."""
    return _rounded(curate(_closed(spark, sf_dir)).groupBy("fico_band", "grade").agg(
        F.count(F.lit(1)).alias("loans"), F.sum("default_flag").alias("defaults"), F.avg("default_flag").alias("default_rate")))


# ---------------------------------------------------------------- split, preprocessing

_NUMERIC = ("loan_amnt", "annual_inc", "dti_clean", "credit_utilization", "fico_midpoint", "loan_to_income_ratio")
_CATEGORICAL = ("grade", "term", "fico_band", "home_ownership")
_TRAIN_SQL = f"{LOANS_SQL}, train AS (SELECT * FROM loans WHERE issue_d <= TIMESTAMP '{TRAIN_END}'), test AS (SELECT * FROM loans WHERE issue_d >= TIMESTAMP '{TEST_START}')"


def _split(spark, sf_dir, keep: tuple[str, ...] = ()) -> split.TimeSplit:
    loans = default_target(_closed(spark, sf_dir)).transform(feature_matrix)
    return split.time_split(loans.select("loan_id", "issue_d", "default_flag", *_NUMERIC, *_CATEGORICAL, *keep),
                            date_column="issue_d", train_end_date=TRAIN_END, test_start_date=TEST_START)


for _side in ("train", "test"):
    _query(f"split_{_side}", f"WITH {_TRAIN_SQL} SELECT loan_id, default_flag, {_r('loan_amnt')} FROM {_side}")(
        lambda spark, sf_dir, side=_side: _rounded(getattr(_split(spark, sf_dir), side).select("loan_id", "default_flag", "loan_amnt")))


@_query("split_stats", f"""WITH {LOANS_SQL} SELECT count(*) AS rows, strftime(min(issue_d), '%Y-%m-%d') AS first_date, strftime(max(issue_d), '%Y-%m-%d') AS last_date,
  count(*) FILTER (issue_d <= TIMESTAMP '{TRAIN_END}') AS train_rows, count(*) FILTER (issue_d >= TIMESTAMP '{TEST_START}') AS test_rows,
  count(*) FILTER (issue_d IS NULL) AS missing_dates FROM closed""")
def split_stats(spark, sf_dir):
    found = split.split_stats(_closed(spark, sf_dir), date_column="issue_d", train_end_date=TRAIN_END, test_start_date=TEST_START)
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_date", "last_date")})


_ROUTING = preprocess.Routing(list(_NUMERIC), list(_CATEGORICAL))
_MODE = "(SELECT {0} FROM train WHERE {0} IS NOT NULL GROUP BY {0} ORDER BY count(*) DESC, {0} LIMIT 1)"
_MEDIANS = "medians AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in _NUMERIC) + " FROM train)"
_FILLED = "filled AS (SELECT t.loan_id, " + ", ".join(f"coalesce(t.{c}, m.{c}) AS {c}" for c in _NUMERIC) + " FROM train t, medians m)"


@_query("route_columns", f"""WITH {_TRAIN_SQL} SELECT unnest([{', '.join(f"'{c}'" for c in (*_NUMERIC, "total_credit_limit", "dti", *_CATEGORICAL))}]) AS "column",
  unnest([true, true, true, true, true, true, true, (SELECT count(*) FILTER (dti = 'n/a') = 0 FROM train), false, false, false, false]) AS "numeric" """)
def route_columns(spark, sf_dir):
    train = _split(spark, sf_dir, keep=("total_credit_limit", "dti")).train.drop("loan_id", "default_flag")
    found = preprocess.route_columns(train)
    return spark.createDataFrame([(c, True) for c in found.numeric] + [(c, False) for c in found.categorical], "column string, numeric boolean")


@_query("median_mode_impute", f"""WITH {_TRAIN_SQL}, {_MEDIANS} SELECT t.loan_id, {", ".join(f"round(coalesce(t.{c}, m.{c}), 6) AS {c}" for c in _NUMERIC)},
  {", ".join(f"coalesce(t.{c}, {_MODE.format(c)}) AS {c}" for c in _CATEGORICAL)} FROM test t, medians m""")
def median_mode_impute(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    fill = preprocess.medians_and_modes(train, _ROUTING)
    return _rounded(preprocess.impute(test, _ROUTING, fill).drop("default_flag"))


@_query("standard_scale", f"""WITH {_TRAIN_SQL}, {_MEDIANS}, {_FILLED}, moments AS (SELECT {", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in _NUMERIC)} FROM filled)
  SELECT loan_id, {", ".join(f"round(({c} - m_{c}) / s_{c}, 6) + 0.0 AS {c}" for c in _NUMERIC)} FROM filled, moments""")
def standard_scale(spark, sf_dir):
    train = _split(spark, sf_dir).train
    fill = preprocess.medians_and_modes(train, _ROUTING)
    scaled = preprocess.standardize(train, _ROUTING, fill, preprocess.scales(train, _ROUTING, fill)).select("loan_id", *_NUMERIC)
    return scaled.select("loan_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in _NUMERIC])


@_query("one_hot_long", f"""WITH {_TRAIN_SQL}, own AS (SELECT loan_id, {", ".join(f"coalesce({c}, {_MODE.format(c)}) AS {c}" for c in _CATEGORICAL)} FROM test),
  long AS (UNPIVOT own ON {", ".join(_CATEGORICAL)} INTO NAME col VALUE category), seen AS (SELECT DISTINCT col, category FROM (UNPIVOT (SELECT {", ".join(f"coalesce({c}, {_MODE.format(c)}) AS {c}" for c in _CATEGORICAL)} FROM train) ON {", ".join(_CATEGORICAL)} INTO NAME col VALUE category))
  SELECT loan_id, col AS "column", category FROM long SEMI JOIN seen USING (col, category)""")
def one_hot_long(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return preprocess.one_hot_long(test, train, list(_CATEGORICAL), "loan_id")


_SLOTS = ", ".join(f"({k}, '{c}')" for k, c in enumerate(_CATEGORICAL))


@_query("one_hot_fitted", ORACLE_SQL["one_hot_long"].split("SELECT loan_id, col AS")[0] + f""", places(k, col) AS (VALUES {_SLOTS}),
  slots AS (SELECT col, category, row_number() OVER (ORDER BY k, category) - 1 + {len(_NUMERIC)} AS slot FROM seen JOIN places USING (col))
  SELECT loan_id, CAST(slot AS INT) AS slot FROM long JOIN slots USING (col, category)""")
def one_hot_fitted(spark, sf_dir):
    """The slots of the fitted preprocessor's vectors that stand for categories and are 1."""
    train, test = _split(spark, sf_dir)
    model = preprocess.fit_preprocessor(train, exclude=("loan_id", "default_flag"))
    slots = model.transform(test).select("loan_id", F.posexplode(vector_to_array("features")).alias("slot", "x"))
    return slots.filter((F.col("slot") >= len(_NUMERIC)) & (F.col("x") == 1)).select("loan_id", "slot")


@_query("class_weights", f"""WITH {_TRAIN_SQL}, c AS (SELECT default_flag AS label, count(*) AS total FROM train GROUP BY 1)
  SELECT CAST(label AS INT) AS label, total, round((SELECT sum(total) FROM c) / (2 * total), 6) AS weight FROM c""")
def class_weights(spark, sf_dir):
    return _rounded(models.class_weights(_split(spark, sf_dir).train))


# ---------------------------------------------------------------- evaluation

_COUNTS = """s AS ({0}), c AS (SELECT score, count(*)::DOUBLE AS total, sum(label)::DOUBLE AS positives FROM s GROUP BY score),
  t AS (SELECT sum(positives) AS p, sum(total) AS a FROM c),
  r AS (SELECT *, sum(total) OVER (ORDER BY score DESC) AS above, sum(positives) OVER (ORDER BY score DESC) AS above_positives FROM c)"""
_AUC = "SELECT sum((total - positives) * (above_positives - positives / 2)) / max(p) / max(a - p) AS auc_roc FROM r, t"
_KS = "SELECT max(abs(above_positives / p - (above - above_positives) / (a - p))) AS ks_statistic FROM r, t"
_AP = "SELECT sum(positives / p * above_positives / above) AS average_precision FROM r, t"
_BRIER = "SELECT avg(power(score - label, 2)) AS brier_score FROM s"
_COSTS = """g AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(1, 100) x(i)), costs AS (SELECT threshold,
  count(*) FILTER (score >= threshold AND label = 1) AS true_positives, count(*) FILTER (score >= threshold AND label = 0) AS false_positives,
  count(*) FILTER (score < threshold AND label = 0) AS true_negatives, count(*) FILTER (score < threshold AND label = 1) AS false_negatives,
  count(*) FILTER (score >= threshold) / count(*) AS predicted_default_rate, count(*) FILTER (score < threshold) / count(*) AS approval_rate,
  5.0::DOUBLE * count(*) FILTER (score < threshold AND label = 1) + 1.0::DOUBLE * count(*) FILTER (score >= threshold AND label = 0) AS total_cost FROM g, s GROUP BY threshold)"""
_COST_COLUMNS = "threshold, true_positives, false_positives, true_negatives, false_negatives, round(predicted_default_rate, 6) AS predicted_default_rate, round(approval_rate, 6) AS approval_rate, total_cost"


def _counts(spark, sf_dir, source):
    return evaluation.score_counts(SCORED[source](spark, sf_dir))


def _metric(name: str, sources: tuple[str, ...], make, sql: str, needs: str = ""):
    for source in sources:
        full = f"WITH {_COUNTS.format(SCORED_SQL[source])}{needs} {sql}"
        _query(f"{name}_{source}", full)(lambda spark, sf_dir, source=source: _rounded(make(spark, sf_dir, source)))


def _one(metric):
    return lambda spark, sf_dir, source: metric(_counts(spark, sf_dir, source))


_ALL = ("loans", "items", "ties", "events")
for _name, _make, _sql in (("auc_roc", evaluation.auc_roc, _AUC), ("ks", evaluation.ks_statistic, _KS), ("average_precision", evaluation.average_precision, _AP),
                           ("brier", evaluation.brier_score, _BRIER)):
    _metric(_name, _ALL, _one(_make), f"SELECT round(x, 6) AS {_sql.split(' AS ')[-1].split(' ')[0]} FROM ({_sql}) y(x)")

_metric("default_rate", ("loans",), _one(evaluation.default_rate), "SELECT round(avg(label), 6) AS default_rate FROM s")
_metric("pr_curve", ("loans", "items"), _one(evaluation.precision_recall),
        f"""SELECT round(score, 6) AS threshold, round(above_positives / above, 6) AS precision, round(above_positives / p, 6) AS recall, round(average_precision, 6) AS average_precision
        FROM r, t, ({_AP}) UNION ALL SELECT NULL, 1.0, 0.0, round(average_precision, 6) FROM ({_AP})""")
_metric("threshold_costs", _ALL, lambda spark, sf_dir, source: evaluation.threshold_costs(SCORED[source](spark, sf_dir)), f"SELECT {_COST_COLUMNS} FROM costs", f", {_COSTS}")
_metric("selected_threshold", ("loans", "items"), lambda spark, sf_dir, source: evaluation.selected_threshold(evaluation.threshold_costs(SCORED[source](spark, sf_dir))),
        f"SELECT {_COST_COLUMNS} FROM costs ORDER BY total_cost, threshold LIMIT 1", f", {_COSTS}")
_metric("calibration_curve", _ALL, lambda spark, sf_dir, source: calibration.calibration_curve(_counts(spark, sf_dir, source)),
        """SELECT round(avg(score), 6) AS mean_predicted_probability, round(avg(label), 6) AS observed_default_rate FROM b GROUP BY bin""",
        """, e AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM s),
        b AS (SELECT score, label, len(list_filter(edges, lambda e: e < score)) AS bin FROM s, e)""")


def _report(spark, sf_dir, source):
    scored = SCORED[source](spark, sf_dir)
    return evaluation.metrics_report(evaluation.score_counts(scored), evaluation.selected_threshold(evaluation.threshold_costs(scored)))


_metric("metrics_report", ("loans", "items"), _report,
        f"""SELECT {_r("auc_roc", "average_precision", "ks_statistic", "brier_score", "default_rate", "approval_rate")}, threshold AS selected_threshold, total_cost AS selected_threshold_total_cost
        FROM ({_AUC}), ({_AP}), ({_KS}), ({_BRIER}), (SELECT avg(label) AS default_rate FROM s), (SELECT * FROM costs ORDER BY total_cost, threshold LIMIT 1)""", f", {_COSTS}")


# ---------------------------------------------------------------- sources and sinks: written, read back, compared


def _place(spark: SparkSession, suffix: str = "") -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}{suffix}"


def _landed(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """The raw loans as a file of the kind, as they would be landed."""
    path = _place(spark, f".{kind}")
    rows = raw_loans(spark, sf_dir)
    if kind == "csv":
        rows.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    else:
        rows.write.parquet(path)
    return path


@_query("read_csv", f"""WITH {RAW_SQL} SELECT CAST(loan_id AS VARCHAR) AS loan_id, status, nullif(dti, 'n/a') AS debt_to_income, revol_util AS "revolUtil", grade, term,
  CAST(fico_range_low AS VARCHAR) AS fico_range_low, round(loan_amnt, 6) AS loan_amount, url, "desc" FROM raw""")
def read_csv(spark, sf_dir):
    rows = read_raw_loans(spark, _landed(spark, sf_dir, "csv"))
    return _rounded(rows.select("loan_id", F.trim("status").alias("status"), "debt_to_income", "revolUtil", "grade", "term", "fico_range_low",
                                F.col("loan_amount").cast("double").alias("loan_amount"), "url", "desc"))


@_query("read_parquet", f"""WITH {RAW_SQL} SELECT loan_id, status, dti AS debt_to_income, revol_util AS "revolUtil", grade, term, fico_range_low, round(loan_amnt, 6) AS loan_amount,
  round(annual_inc, 6) AS annual_income, url FROM raw""")
def read_parquet(spark, sf_dir):
    rows = read_raw_loans(spark, _landed(spark, sf_dir, "parquet"))
    return _rounded(rows.select("loan_id", F.trim("status").alias("status"), "debt_to_income", "revolUtil", "grade", "term", "fico_range_low", "loan_amount", "annual_income", "url"))


for _kind in ("csv", "parquet"):
    _query(f"load_loans_{_kind}", f"""WITH {LOANS_SQL} SELECT loan_id, lower(status) AS loan_status, strftime(issue_d, '%Y-%m-%d') AS issue_d, round(loan_amnt, 6) AS loan_amnt,
      home_ownership, addr_state, "desc" FROM closed""")(lambda spark, sf_dir, kind=_kind: _rounded(load_loans(spark, _landed(spark, sf_dir, kind)).select(
          F.col("loan_id").cast("bigint").alias("loan_id"), F.lower(F.trim("loan_status")).alias("loan_status"), F.date_format("issue_d", "yyyy-MM-dd").alias("issue_d"),
          F.col("loan_amnt").cast("double").alias("loan_amnt"), "home_ownership", "addr_state", "desc")))


@_query("curated_parquet", f"""WITH {LOANS_SQL} SELECT CAST(year(issue_d) AS INT) AS issue_year, grade, count(*) AS loans, sum(default_flag)::BIGINT AS defaults, round(avg(dti_clean), 6) AS dti,
  round(avg(credit_utilization), 6) AS utilization, count(loan_to_income_ratio) AS with_income FROM loans GROUP BY ALL""")
def curated_parquet(spark, sf_dir):
    path = _place(spark)
    write_curated(curate(_closed(spark, sf_dir)), path)
    return _rounded(spark.read.parquet(path).groupBy("issue_year", "grade").agg(
        F.count(F.lit(1)).alias("loans"), F.sum("default_flag").alias("defaults"), F.avg("dti_clean").alias("dti"),
        F.avg("credit_utilization").alias("utilization"), F.count("loan_to_income_ratio").alias("with_income")))


@_query("curated_stream", f"""WITH {LOANS_SQL} SELECT grade, fico_band, term, count(*) AS loans, sum(default_flag)::BIGINT AS defaults, round(avg(dti_clean), 6) AS dti FROM loans GROUP BY ALL""")
def curated_stream(spark, sf_dir):
    """Raw loans that arrive as files are curated by a stream, which takes in what is there and ends."""
    landed, path = _landed(spark, sf_dir, "parquet"), _place(spark)
    raw = spark.readStream.schema(spark.read.parquet(landed).schema).parquet(landed)
    query = (curate_stream(raw).writeStream.format("parquet").option("path", path).option("checkpointLocation", _place(spark)).trigger(availableNow=True).start())
    query.awaitTermination()
    return _rounded(spark.read.parquet(path).groupBy("grade", "fico_band", "term").agg(
        F.count(F.lit(1)).alias("loans"), F.sum("default_flag").alias("defaults"), F.avg("dti_clean").alias("dti")))


_REPLACED = 1998


@_query("curated_replaced", f"""WITH {LOANS_SQL} SELECT CAST(year(issue_d) AS INT) AS issue_year, count(*) AS loans, count(*) FILTER (year(issue_d) = {_REPLACED}) AS corrected,
  year(issue_d) <> {_REPLACED} AS same_files FROM loans GROUP BY year(issue_d)""")
def curated_replaced(spark, sf_dir):
    """One year of the curated table is replaced; the files of the others stay."""
    path = _place(spark)
    features = curate(_closed(spark, sf_dir))
    write_curated(features, path)
    files = lambda: read_curated(spark, path).select("issue_year", F.col("_metadata.file_name").alias("file")).groupBy("issue_year").agg(F.sort_array(F.collect_set("file")).alias("files"))
    before = {r["issue_year"]: r["files"] for r in files().collect()}  # a row per year
    write_curated(features.filter(F.year("issue_d") == _REPLACED).withColumn("grade", F.lit("Z")), path, replace_years=True)
    same = [(r["issue_year"], before[r["issue_year"]] == r["files"]) for r in files().collect()]
    found = read_curated(spark, path).groupBy("issue_year").agg(F.count(F.lit(1)).alias("loans"), F.count_if(F.col("grade") == "Z").alias("corrected"))
    return found.join(spark.createDataFrame(same, "issue_year int, same_files boolean"), "issue_year")


for _side in ("train", "test"):
    _query(f"split_curated_{_side}", f"""WITH {_TRAIN_SQL} SELECT grade, fico_band, count(*) AS loans, sum(default_flag)::BIGINT AS defaults, round(sum(loan_amnt), 2) AS amount
      FROM {_side} GROUP BY ALL""")(lambda spark, sf_dir, side=_side: _split_curated(spark, sf_dir, side))


def _split_curated(spark, sf_dir, side: str) -> DataFrame:
    """A split of the written table, which reads the files of its own years."""
    path = _place(spark)
    write_curated(curate(_closed(spark, sf_dir)), path)
    rows = getattr(split.time_split(read_curated(spark, path), date_column="issue_d", train_end_date=TRAIN_END, test_start_date=TEST_START, year_column="issue_year"), side)
    return rows.groupBy("grade", "fico_band").agg(F.count(F.lit(1)).alias("loans"), F.sum("default_flag").alias("defaults"), F.round(F.sum("loan_amnt"), 2).alias("amount"))


def _written(spark, sf_dir) -> dict[str, str]:
    """The reports of the scored loans."""
    scored = SCORED["loans"](spark, sf_dir)
    counts, costs = evaluation.score_counts(scored), evaluation.threshold_costs(scored)
    return write_reports(_place(spark), "loans", metrics=evaluation.metrics_report(counts, evaluation.selected_threshold(costs)),
                         calibration=calibration.calibration_curve(counts), thresholds=costs)


for _name, _file, _of, _read in (
        ("metrics_json", "metrics.json", "metrics_report_loans", lambda spark, path: read_metrics(spark, path)),
        ("calibration_csv", "calibration.csv", "calibration_curve_loans", lambda spark, path: read_report_rows(spark, path, CALIBRATION_SCHEMA)),
        ("threshold_costs_csv", "threshold_costs.csv", "threshold_costs_loans", lambda spark, path: read_report_rows(spark, path, THRESHOLD_SCHEMA))):
    _query(_name, ORACLE_SQL[_of])(lambda spark, sf_dir, file=_file, read=_read: _rounded(read(spark, _written(spark, sf_dir)[file])))


# ---------------------------------------------------------------- models


def _fitted(spark, sf_dir, model_type: str, **config):
    train, test = _split(spark, sf_dir)
    return models.train_model(train, model_type, config=config, exclude=("loan_id",)), test


@_query("lr_scores")
def lr_scores(spark, sf_dir):
    model, test = _fitted(spark, sf_dir, "logistic_regression")
    return models.score(model, test, keep=("loan_id", "default_flag"))


@_query("gbt_scores")
def gbt_scores(spark, sf_dir):
    model, test = _fitted(spark, sf_dir, "boosted_trees")
    return models.score(model, test, keep=("loan_id", "default_flag"))


# one tree of depth 1 on one column: the cut between two values that leaves the least variance, and the means of its sides
@_query("gbt_stump", f"""WITH {_TRAIN_SQL}, v AS (SELECT fico_midpoint AS x, count(*)::DOUBLE AS n, sum(2 * default_flag - 1)::DOUBLE AS s FROM train GROUP BY 1),
  o AS (SELECT (x + lead(x) OVER (ORDER BY x)) / 2 AS cut, sum(n) OVER (ORDER BY x) AS nl, sum(s) OVER (ORDER BY x) AS sl, sum(n) OVER () AS n, sum(s) OVER () AS s FROM v),
  best AS (SELECT *, sl / nl AS low, (s - sl) / (n - nl) AS high FROM o WHERE cut IS NOT NULL ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC LIMIT 1)
  SELECT loan_id, round(1 / (1 + exp(-2 * CASE WHEN fico_midpoint <= cut THEN low ELSE high END)), 6) AS default_probability FROM test, best""")
def gbt_stump(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    model = models.train_boosted_trees(train.select("default_flag", "fico_midpoint"), config={
        "n_estimators": 1, "max_depth": 1, "subsample": 1.0, "colsample_bytree": 1.0, "max_bin": 128})
    return _rounded(models.score(model, test, keep=("loan_id",)))


@_query("lr_optimality", f"""WITH {_TRAIN_SQL}, slots AS (SELECT {len(_NUMERIC)} + {" + ".join(f"(SELECT count(DISTINCT {c}) FROM train)" for c in _CATEGORICAL)} AS n)
  SELECT CAST(unnest(range(-1, n)) AS INT) AS slot, true AS optimal FROM slots""")
def lr_optimality(spark, sf_dir):
    """Whether the gradient of the penalised loss is nil in each coefficient (slot -1: the
    intercept), against the sum of what the rows pull either way."""
    train = _split(spark, sf_dir).train
    model = models.train_logistic_regression(train, exclude=("loan_id",))
    fitted = model.stages[-1]
    weights = models.class_weights(train).select(F.col("label").alias("default_flag"), "weight")
    scored = model.transform(train).join(F.broadcast(weights), "default_flag")  # two rows
    error = F.col("weight") * (vector_to_array("probability")[1] - F.col("default_flag"))
    # sums per slot of both signs of the error and of the sizes, a vector each
    sums = scored.select(error.alias("e"), "weight", "features").agg(
        F.sum("e").alias("e"), F.sum("weight").alias("weight"),
        *[Summarizer.sum(F.col("features"), F.greatest(sign * F.col("e"), F.lit(0.0))).alias(name) for name, sign in (("up", 1), ("down", -1))],
        Summarizer.normL1(F.col("features"), F.col("weight")).alias("most"))
    slots = F.arrays_zip(*[vector_to_array(c).alias(c) for c in ("up", "down", "most")])
    slot = sums.select("e", "weight", F.posexplode(slots).alias("slot", "s")).select("slot", (F.col("s.up") - F.col("s.down")).alias("pull"), F.col("s.most").alias("most"))
    pulls = slot.union(sums.select(F.lit(-1), "e", "weight"))
    held = spark.createDataFrame([(-1, 0.0), *((k, float(w)) for k, w in enumerate(fitted.coefficients))], "slot int, penalty double")
    return pulls.join(F.broadcast(held), "slot").select("slot", (F.abs(F.col("pull") + F.col("penalty")) <= 1e-4 * F.col("most")).alias("optimal"))


@_query("saved_model_scores", f"WITH {_TRAIN_SQL} SELECT loan_id, true AS same, true AS logistic FROM test")
def saved_model_scores(spark, sf_dir):
    """A model that is saved and read again scores alike, and the score is the logistic of its margin."""
    model, test = _fitted(spark, sf_dir, "logistic_regression", max_iter=20)
    path = _place(spark)
    model.write().save(path)
    first = models.score(model, test, keep=("loan_id",))
    again = PipelineModel.load(path).transform(test).select("loan_id", vector_to_array("probability")[1].alias("p"), vector_to_array("rawPrediction")[1].alias("margin"))
    return first.join(again, "loan_id").select("loan_id", (F.col("p") == F.col("default_probability")).alias("same"),
                                               (F.abs(1 / (1 + F.exp(-F.col("margin"))) - F.col("p")) < 1e-12).alias("logistic"))


def _calibrated(spark, sf_dir, method: str):
    scored = SCORED["loans"](spark, sf_dir)
    fitted = calibration.calibrate_scores(scored, method=method)
    counts = evaluation.score_counts(scored)
    model = calibration.CalibratedModel(_Same(), fitted, method, False)
    return _rounded(model.transform(counts).select("score", "total", "default_probability"), 4)


class _Same:
    """Scores that are there already, as a model's output."""

    def transform(self, counts: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        return counts.withColumn("probability", array_to_vector(F.array(1 - F.col("score"), F.col("score"))))


# the isotonic fit at i is the largest over a <= i of the least mean over a..b, b >= i
_query("isotonic_calibration", f"""WITH {_COUNTS.format(SCORED_SQL["loans"])}, o AS (SELECT *, row_number() OVER (ORDER BY score) AS i,
  sum(positives) OVER (ORDER BY score) AS p, sum(total) OVER (ORDER BY score) AS q FROM c),
  pairs AS (SELECT a.i AS a, b.i AS b, (b.p - a.p + a.positives) / (b.q - a.q + a.total) AS mean FROM o a JOIN o b ON a.i <= b.i),
  least AS (SELECT a, b, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS mean FROM pairs),
  fit AS (SELECT b AS i, max(mean) AS rate FROM least GROUP BY b)
  SELECT round(score, 4) AS score, total::BIGINT AS total, round(rate, 4) AS default_probability FROM fit JOIN o USING (i)""")(
    lambda spark, sf_dir: _calibrated(spark, sf_dir, "isotonic"))
# Newton steps for slope and intercept
_query("sigmoid_calibration", f"""WITH RECURSIVE {_COUNTS.format(SCORED_SQL["loans"])},
  w AS (SELECT score, total, positives * (p + 1) / (p + 2) + (total - positives) / (a - p + 2) AS target FROM c, t),
  newton(i, slope, base) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
    SELECT i + 1, slope - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), base - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM (
      SELECT i, slope, base, sum((total * x - target) * score) AS g1, sum(total * x - target) AS g2, sum(total * x * (1 - x) * score * score) AS h11,
        sum(total * x * (1 - x) * score) AS h12, sum(total * x * (1 - x)) AS h22
      FROM (SELECT *, 1 / (1 + exp(-(slope * score + base))) AS x FROM newton, w) GROUP BY i, slope, base) WHERE i < 25)
  SELECT round(score, 4) AS score, total::BIGINT AS total, round(1 / (1 + exp(-(slope * score + base))), 4) AS default_probability FROM w, newton WHERE i = 25""")(
    lambda spark, sf_dir: _calibrated(spark, sf_dir, "sigmoid"))


# ---------------------------------------------------------------- whole jobs

#: The metrics of scores in SQL, by windows over their order: what the reports of a job must say.
_SCORES_SQL = """WITH ordered AS (
  SELECT label, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS place, sum(label) OVER (ORDER BY score DESC) AS tp,
    count(*) OVER (ORDER BY score DESC) AS above, row_number() OVER (PARTITION BY score ORDER BY label) AS first FROM scores),
  sums AS (SELECT sum(label) AS p, count(*) - sum(label) AS n FROM scores),
  steps AS (SELECT score, max(tp) AS tp, max(above) AS above, sum(label) AS own FROM ordered GROUP BY score)
  SELECT (SELECT (sum(CASE WHEN label = 1 THEN place END) - max(p) * (max(p) + 1) / 2) / max(p) / max(n) FROM ordered, sums) AS auc_roc,
    (SELECT sum(own / p * tp / above) FROM steps, sums) AS average_precision, (SELECT max(abs(tp / p - (above - tp) / n)) FROM steps, sums) AS ks_statistic,
    (SELECT avg(power(score - label, 2)) FROM scores) AS brier_score"""
_CHECKED = ("auc_roc", "average_precision", "ks_statistic", "brier_score")
_JOB_SQL = f"""WITH {_TRAIN_SQL} SELECT 'MODEL' AS model_type, 5.0::DOUBLE AS false_negative_cost, round(avg(default_flag), 6) AS default_rate, 99 AS thresholds,
  sum(default_flag)::BIGINT AS defaults, count(*) AS loans, true AS curve, count(*) AS scores, sum(default_flag)::BIGINT AS labels, {", ".join(f"true AS {c}" for c in _CHECKED)}, true AS better_than_chance FROM test"""


def _reports(spark, output: str, model_type: str) -> DataFrame:
    """What the reports of a run say of the later loans, and whether its metrics are those that SQL finds in the scores it wrote."""
    at = f"{output}/metrics/{model_type}_"
    metrics = read_metrics(spark, f"{at}metrics.json")
    scores = spark.read.parquet(newest_stage(spark, f"{output}/stages", "scores"))
    again = spark.sql(_SCORES_SQL.replace("FROM scores", "FROM {scores}"), scores=scores).select(*[F.col(c).alias(f"sql_{c}") for c in _CHECKED])
    costs = read_report_rows(spark, f"{at}threshold_costs.csv", THRESHOLD_SCHEMA).agg(
        F.count(F.lit(1)).cast("int").alias("thresholds"), F.max(F.col("true_positives") + F.col("false_negatives")).alias("defaults"),
        F.min(F.col("true_positives") + F.col("false_negatives") + F.col("true_negatives") + F.col("false_positives")).alias("loans"))
    curve = read_report_rows(spark, f"{at}calibration.csv", CALIBRATION_SCHEMA).agg((F.count(F.lit(1)).between(1, 10)).alias("curve"))
    sums = scores.agg(F.count(F.lit(1)).alias("scores"), F.sum("label").cast("bigint").alias("labels"))
    joined = metrics
    for one in (again, costs, curve, sums):  # one row each
        joined = joined.join(F.broadcast(one), F.lit(True))
    return joined.select("model_type", "false_negative_cost", F.round("default_rate", 6).alias("default_rate"), "thresholds", "defaults", "loans", "curve", "scores", "labels",
                         *[(F.abs(F.col(c) - F.col(f"sql_{c}")) < 1e-9).alias(c) for c in _CHECKED], (F.col("auc_roc") > 0.4).alias("better_than_chance"))


_DATES = {"train_end_date": TRAIN_END, "test_start_date": TEST_START}


@_query("baseline_job", _JOB_SQL.replace("MODEL", "logistic_regression"))
def baseline_job(spark, sf_dir):
    output = _place(spark)
    job.run_baseline(spark, _landed(spark, sf_dir, "parquet"), output_dir=output, **_DATES)
    return _reports(spark, output, "logistic_regression")


@_query("submitted_job", _JOB_SQL.replace("MODEL", "boosted_trees"))
def submitted_job(spark, sf_dir):
    """The command line, with parameters of its own."""
    output = _place(spark)
    code = job.main([_landed(spark, sf_dir, "csv"), "--train-end-date", TRAIN_END, "--test-start-date", TEST_START, "--output-dir", output,
                     "--model-type", "boosted_trees", "--model-config", '{"max_depth": 3}'])
    if code:
        raise RuntimeError("The job failed.")
    return _reports(spark, output, "boosted_trees")


@_query("landed_csv_job", _JOB_SQL.replace("MODEL", "logistic_regression"))
def landed_csv_job(spark, sf_dir):
    output = _place(spark)
    job.refresh_reports(spark, _landed(spark, sf_dir, "csv"), output_dir=output, **_DATES)
    return _reports(spark, output, "logistic_regression")


@_query("landing_folder", _JOB_SQL.replace("MODEL", "logistic_regression").replace(" FROM test", """,
  (SELECT count(*) FROM raw) AS taken_in, (SELECT count(*) FROM raw WHERE k % 40 = 0) AS odd_records, 1::BIGINT AS odd_files FROM test"""))
def landing_folder(spark, sf_dir):
    """Loans land in two lots, one of which lands again under another name; records that do not fit and a file without a header go to quarantine."""
    folder, table, output, checkpoint = (_place(spark) for _ in range(4))
    rows, k = raw_loans(spark, sf_dir), F.col("loan_id")
    for name, lot in (("first", rows.filter(k % 2 == 0)), ("second", rows.filter(k % 2 == 1))):
        lot.write.csv(f"{folder}/{name}", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    odd = rows.filter(k % 40 == 0).select(F.concat_ws(",", k.cast("string"), F.lit("Current"), F.lit("one too many")).alias("value"))
    head = spark.createDataFrame([("loan_id,status",)], "value string")
    head.union(odd).coalesce(1).write.text(f"{folder}/odd")
    spark.createDataFrame([("nothing",), ("1",)], "value string").coalesce(1).write.text(f"{folder}/plain")
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = files.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in ("odd", "plain"):  # texts as .csv files
        for f in input_files(spark, f"{folder}/{name}"):
            if f[0].endswith(".txt"):
                system.rename(files.Path(f[0]), files.Path(f[0].removesuffix(".txt") + ".csv"))
    landing.take_in_folder(spark, folder, table, checkpoint)
    files.FileUtil.copy(system, files.Path(f"{folder}/first"), system, files.Path(f"{folder}/again"), False, spark.sparkContext._jsc.hadoopConfiguration())
    landing.refresh_from_folder(spark, folder, table, checkpoint, output_dir=output, **_DATES)
    taken = spark.read.option("mergeSchema", True).parquet(f"{table}/loans.parquet").agg(F.count(F.lit(1)).alias("taken_in"))
    rejects = spark.read.parquet(f"{table}/rejects.parquet").agg(F.count_if(F.col("reason") == "record").alias("odd_records"), F.count_if(F.col("reason") == "header").alias("odd_files"))
    return _reports(spark, output, "logistic_regression").join(F.broadcast(taken), F.lit(True)).join(F.broadcast(rejects), F.lit(True))  # one row each
