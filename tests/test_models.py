"""Split, preprocessing, models, metrics, calibration and the whole job."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from credence.operators import calibration, evaluation, isotonic, models, preprocess
from credence.operators.evaluation import CostMatrix
from credence.operators.prefix import running_totals
from credence.operators.split import time_split
from credence.plans import job
from credence.sources.reports import CALIBRATION_SCHEMA, THRESHOLD_SCHEMA, read_metrics, read_report_rows


def test_split(spark):
    rows = spark.createDataFrame([("2016-01-01", 1, 0), ("2016-12-31", 2, 1), ("2016-12-31 05:00", 5, 1), ("2017-01-01", 3, 0), ("2018-01-01", 4, 1)], "issue_d string, x int, default_flag int")
    train, test = time_split(rows, date_column="issue_d", train_end_date="2016-12-31", test_start_date="2017-01-01")
    assert {r["x"] for r in train.collect()} == {1, 2} and {r["x"] for r in test.collect()} == {3, 4} and "issue_d" not in train.columns
    late = spark.createDataFrame([("2018-01-01", 0), ("2018-03-01", 1)], "issue_d string, default_flag int")
    with pytest.raises(ValueError, match="Available date range is 2018-01-01 to 2018-03-01"):
        time_split(late, date_column="issue_d", train_end_date="2016-12-31", test_start_date="2017-01-01")
    with pytest.raises(ValueError, match="without a valid date"):
        time_split(spark.createDataFrame([("soon", 0)], "issue_d string, y int"), date_column="issue_d", train_end_date="2016-12-31", test_start_date="2017-01-01")
    with pytest.raises(ValueError):
        time_split(rows, date_column="issue_d", train_end_date="2017-01-01", test_start_date="2017-01-01")
    with pytest.raises(KeyError):
        time_split(rows, date_column="d", train_end_date="2016-01-01", test_start_date="2017-01-01")


def test_preprocessing(spark):
    train = spark.createDataFrame([("1", 5.0, "b", None, 7), ("3", None, "a", None, 7), (None, float("nan"), None, None, 7), ("5", 1.0, None, None, 7)], "s string, x double, c string, empty string, same int")
    routing = preprocess.route_columns(train)
    assert routing.numeric == ["s", "x", "same"] and routing.categorical == ["c"]
    assert preprocess.medians_and_modes(train, routing) == {"s": 3.0, "x": 3.0, "same": 7.0, "c": "a"}
    model = preprocess.fit_preprocessor(train)
    new = spark.createDataFrame([("9", None, "z", None, 8)], train.schema)
    got = model.transform(new).select(vector_to_array("features").alias("f")).first()["f"]
    assert got == pytest.approx([(9 - 3) / np.std([1, 3, 3, 5]), 0.0, 1.0, 0.0, 0.0])
    assert preprocess.route_columns(train, categorical=["s"]).categorical == ["s", "c"]
    with pytest.raises(ValueError):
        preprocess.route_columns(train.select("empty"))


def test_logistic_optimum(spark):
    rng = random.Random(3)
    rows = [(x := rng.gauss(0, 1), y := rng.choice("abc"), int(rng.random() < 1 / (1 + math.exp(-x - (y == "a"))))) for _ in range(200)]
    train = spark.createDataFrame(rows, "x double, c string, default_flag int")
    model = models.train_logistic_regression(train)
    fitted = model.stages[-1]
    X = np.array([r["f"] for r in model.transform(train).select(vector_to_array("features").alias("f")).collect()])
    y = np.array([r[2] for r in rows])
    w, b = fitted.coefficients.toArray(), fitted.intercept
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    error = weight * (1 / (1 + np.exp(-(X @ w + b))) - y)
    assert np.abs(w + X.T @ error).max() < 1e-3 and abs(error.sum()) < 1e-3
    p = [r[0] for r in models.score(model, train, keep=()).collect()]
    assert min(p) >= 0 and max(p) <= 1
    with pytest.raises(ValueError):
        models.train_model(train, "forest")
    with pytest.raises(ValueError):
        models.train_logistic_regression(train, config={"nope": 1})


def test_boosted_trees(spark):
    rng = random.Random(5)
    rows = [(x := rng.random(), int((x > 0.5) != (rng.random() < 0.1))) for _ in range(200)]
    train = spark.createDataFrame(rows, "x double, default_flag int")
    config = {"n_estimators": 5, "max_depth": 2}
    a, b = (models.score(models.train_boosted_trees(train, config=config), train) for _ in range(2))
    assert [r[1] for r in a.collect()] == [r[1] for r in b.collect()]
    counts = evaluation.score_counts(a, "default_flag", "default_probability")
    assert evaluation.auc_roc(counts).first()[0] > 0.8


def _brute(pairs):
    y, s = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    P, N = y.sum(), len(y) - y.sum()
    diff = s[y == 1][:, None] - s[y == 0][None]
    auc = ((diff > 0).sum() + 0.5 * (diff == 0).sum()) / P / N
    ks = ap = 0.0
    before = 0.0
    for t in sorted(set(s), reverse=True):
        on = s >= t
        tp, fp = y[on].sum(), on.sum() - y[on].sum()
        ks = max(ks, abs(tp / P - fp / N))
        ap += (tp / P - before) * tp / on.sum()
        before = tp / P
    return auc, ks, ap, np.mean((s - y) ** 2)


@pytest.mark.parametrize("digits", [1, 6])
def test_metrics_equal_brute_force(spark, digits):
    rng = random.Random(digits)
    pairs = [(int(rng.random() < 0.4), round(rng.random(), digits)) for _ in range(400)]
    scored = spark.createDataFrame(pairs, "label int, score double").repartition(5)
    counts = evaluation.score_counts(scored)
    got = [m(counts).first()[0] for m in (evaluation.auc_roc, evaluation.ks_statistic, evaluation.average_precision, evaluation.brier_score)]
    assert got == pytest.approx(_brute(pairs), abs=1e-12)
    twice = evaluation.score_counts(scored.union(scored))
    assert evaluation.auc_roc(twice).first()[0] == pytest.approx(got[0], abs=1e-12)
    curve = evaluation.precision_recall(counts).collect()
    assert curve[-1]["threshold"] is None and curve[-1]["precision"] == 1 and curve[0]["recall"] == 1 and len(curve) == len({s for _, s in pairs}) + 1
    s = np.array([p[1] for p in pairs])
    y = np.array([p[0] for p in pairs])
    edges = np.percentile(s, np.linspace(0, 100, 11))
    bins = np.searchsorted(edges[1:-1], s)
    want = [(s[bins == b].mean(), y[bins == b].mean()) for b in range(10) if (bins == b).any()]
    assert [tuple(r) for r in calibration.calibration_curve(counts).collect()] == [pytest.approx(w) for w in want]


def test_fixtures(spark):
    make = lambda rows: spark.createDataFrame(rows, "label int, score double")
    perfect = evaluation.score_counts(make([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)]))
    assert evaluation.auc_roc(perfect).first()[0] == 1 and evaluation.ks_statistic(perfect).first()[0] == 1
    assert evaluation.brier_score(perfect).first()[0] == pytest.approx(0.025) and evaluation.average_precision(perfect).first()[0] == 1
    ties = evaluation.score_counts(make([(0, 0.1), (1, 0.8), (0, 0.4), (1, 0.35), (1, 0.4)]))
    assert evaluation.auc_roc(ties).first()[0] == pytest.approx(0.75) and evaluation.average_precision(ties).first()[0] == pytest.approx(0.805556, abs=1e-6)
    scored = make([(0, 0.2), (1, 0.4), (1, 0.9), (0, 0.8)])
    costs = evaluation.threshold_costs(scored, cost_matrix=CostMatrix(5, 1), thresholds=[0.7, 0.3, 0.5])
    rows = [tuple(r) for r in costs.collect()]
    assert [r[0] for r in rows] == [0.7, 0.3, 0.5] and rows[1][1:] == (2, 1, 1, 0, 0.75, 0.25, 1.0) and rows[0][1:] == (1, 1, 1, 1, 0.5, 0.5, 6.0)
    assert evaluation.selected_threshold(costs).first()["threshold"] == 0.3
    assert evaluation.threshold_costs(scored).count() == 99
    missing = evaluation.threshold_costs(make([(1, None), (0, float("nan")), (1, 0.5)]), thresholds=[0.5]).first()
    assert (missing["true_positives"], missing["false_positives"], missing["false_negatives"]) == (1, 0, 1)
    with pytest.raises(ValueError):
        evaluation.threshold_costs(scored, thresholds=[])
    one_class = evaluation.score_counts(make([(1, 0.5)]))
    for metric in (evaluation.auc_roc, evaluation.ks_statistic):
        with pytest.raises(ValueError):
            metric(one_class)
    for bad in ([(None, 0.5)], [(1, None)]):
        with pytest.raises(Exception, match="missing"):
            evaluation.score_counts(make([*bad, (1, 0.2), (0, 0.1)])).collect()
    with pytest.raises(Exception, match="outside"):
        evaluation.brier_score(evaluation.score_counts(make([(1, 1.5), (0, 0.2)]))).collect()


def test_running_totals_do_not_need_one_task(spark):
    rows = spark.range(1000).select((F.col("id") / 7).alias("score"), F.lit(1).cast("bigint").alias("total"))
    for ranges in (1, 2, 16):
        got = running_totals(rows, "score", {"until": "total"}, ranges=ranges).orderBy("score").collect()
        assert [r["until"] for r in got] == list(range(1, 1001))


def test_calibration(spark):
    rng = random.Random(1)
    pairs = [(int(rng.random() < s * s), s) for s in (round(rng.random(), 2) for _ in range(500))]
    scored = spark.createDataFrame(pairs, "label int, score double")
    iso = calibration.calibrate_scores(scored, method="isotonic")
    out = [r["_calibrated"] for r in iso.transform(spark.createDataFrame([(k / 10,) for k in range(11)], "_score double")).orderBy("_score").collect()]
    assert out == sorted(out) and 0 <= out[0] and out[-1] <= 1
    model = calibration.calibrate_scores(scored, method="sigmoid")
    y, s = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    residual = 1 / (1 + np.exp(-(model.coefficients[0] * s + model.intercept))) - target
    assert abs(residual.sum()) < 1e-3 and abs(residual @ s) < 1e-3
    with pytest.raises(ValueError):
        calibration.calibrate_scores(scored, method="beta")


def _loans(path, **columns):
    head = list(columns)
    path.write_text(",".join(head) + "\n" + "\n".join(",".join(map(str, row)) for row in zip(*columns.values())) + "\n")
    return str(path)


BASE = {"status": ["Fully Paid", "Charged Off"] * 4, "issue_month": [f"{m}-{y}" for y in (2016, 2017) for m in ("Jan", "Feb", "Mar", "Apr")],
        "loan_amount": [1000 * k for k in range(1, 9)], "annual_income": [50000 + k for k in range(8)], "debt_to_income": [10 + k for k in range(8)], "grade": list("ABABABAB")}


def test_job_end_to_end(spark, tmp_path):
    path = _loans(tmp_path / "a.csv", **BASE, revolUtil=["20%"] * 8, url=["u"] * 8)
    out = str(tmp_path / "out")
    found = job.run_baseline(spark, path, train_end_date="2016-12-31", test_start_date="2017-01-01", output_dir=out)
    assert all(0 <= v <= 1 for v in found.as_dict().values())
    payload = read_metrics(spark, f"{out}/metrics/logistic_regression_metrics.json").first().asDict()
    assert len(payload) == 11 and payload["false_negative_cost"] == 5.0
    assert read_report_rows(spark, f"{out}/metrics/logistic_regression_threshold_costs.csv", THRESHOLD_SCHEMA).count() == 99
    assert 0 < read_report_rows(spark, f"{out}/metrics/logistic_regression_calibration.csv", CALIBRATION_SCHEMA).count() <= 10
    model = PipelineModel.load(f"{out}/models/logistic_regression")
    loans = job.curate(job.load_loans(spark, path))
    assert evaluation.auc_roc(evaluation.score_counts(models.score(model, time_split(loans, date_column="issue_d", train_end_date="2016-12-31", test_start_date="2017-01-01").test), "default_flag", "default_probability")).first()[0] == pytest.approx(found.auc_roc)


def test_job_variants(spark, tmp_path, capsys):
    dates = {"train_end_date": "2016-12-31", "test_start_date": "2017-01-01"}
    path = _loans(tmp_path / "b.csv", **BASE, total_credit_utilized=[2500] * 8, total_credit_limit=[10000] * 8)
    assert set(job.refresh_reports(spark, path, output_dir=str(tmp_path / "o"), **dates)) == {"auc_roc", "average_precision", "ks_statistic"}
    (tmp_path / "c.csv").write_text("nothing\n1\n")
    with pytest.raises(ValueError):
        job.refresh_reports(spark, str(tmp_path / "c.csv"), **dates)
    with pytest.raises(ValueError):
        job.run_baseline(spark, path, model_type="forest", **dates)
    assert job.main([str(tmp_path / "none.csv"), "--train-end-date", "2016-12-31", "--test-start-date", "2017-01-01"]) == 1
    assert "Pipeline failed: There is no input" in capsys.readouterr().err
    json.dumps(job.parse_args(["x", "--train-end-date", "a", "--test-start-date", "b"]).__dict__)


def test_parameters_go_through(spark):
    rng = random.Random(9)
    rows = [(x := rng.gauss(0, 1), rng.gauss(0, 1), int(rng.random() < 1 / (1 + math.exp(-2 * x)))) for _ in range(300)]
    train = spark.createDataFrame(rows, "x double, noise double, default_flag int")
    lasso = models.train_logistic_regression(train, config={"penalty": "l1", "C": 0.02, "class_weight": None, "solver": "saga", "n_jobs": 4}).stages[-1]
    assert lasso.coefficients[1] == 0 != lasso.coefficients[0]
    free = models.train_logistic_regression(train, config={"penalty": None, "fit_intercept": False}).stages[-1]
    assert free.intercept == 0 and abs(free.coefficients[0]) > abs(lasso.coefficients[0])
    given = models.train_logistic_regression(train, config={"class_weight": {1: 3.0}}).stages[-1]
    assert given.intercept > models.train_logistic_regression(train, config={"class_weight": None}).stages[-1].intercept
    trees = models.train_boosted_trees(train, config={"n_estimators": 3, "eta": 0.5, "gamma": 0.01, "min_child_weight": 5, "verbosity": 0}).stages[-1]
    assert trees.getNumTrees == 3 and trees.getStepSize() == 0.5 and trees.getMinInstancesPerNode() == 5
    for bad in ({"penalty": "l3"}, {"class_weight": "heavy"}, {"reg_lambda": 2}):
        with pytest.raises(ValueError):
            models.train_logistic_regression(train, config=bad)
    with pytest.raises(ValueError, match="reg_lambda"):
        models.train_boosted_trees(train, config={"reg_lambda": 2})


def test_chains_merge_to_the_fit_of_all():
    """Blocks of any split into segments, against one pass with a stack; worst cases and equal rates included."""
    rng = random.Random(1)
    for trial in range(600):
        n = rng.randint(1, 40)
        total = [rng.randint(1, rng.choice([1, 3, 50])) for _ in range(n)]
        positives = [rng.randint(0, t) for t in total]
        if trial % 7 == 0:  # rising rates and a last one that pools many
            total, positives = [100] * n, [*sorted(positives)[:-1], 0]
        stack = []
        for p, t in zip(positives, total):
            stack.append([p, t, 1])
            while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
                stack[-2:] = [[x + y for x, y in zip(*stack[-2:])]]
        for segment in (1, 3, 256):
            held = isotonic.chain(np.arange(n, dtype=float), np.array(positives), np.array(total), segment)
            blocks = []
            for p, t, size in zip(held.positives.tolist(), held.total.tolist(), (held.last - held.first + 1).astype(int).tolist()):
                if blocks and blocks[-1][0] * t == p * blocks[-1][1]:  # equal rates may stay apart
                    p, t, size = (x + y for x, y in zip(blocks.pop(), (p, t, size)))
                blocks.append([p, t, size])
            assert blocks == stack
    # the most blocks that rows can make: every fraction once
    fractions = sorted((p / t, p, t) for t in range(1, 60) for p in range(t + 1) if math.gcd(p, t) == 1)
    rows = sum(t for _, _, t in fractions)
    held = isotonic.chain(np.arange(len(fractions), dtype=float), *(np.array([f[k] for f in fractions]) for k in (1, 2)))
    assert len(held) == len(fractions) <= 0.9 * rows ** (2 / 3) + 10


def test_isotonic_points_are_saved(spark, tmp_path):
    counts = spark.createDataFrame([(0.1, 0, 4), (0.2, 3, 4), (0.3, 1, 4), (0.9, 4, 4)], "score double, positives long, total long")
    fitted = isotonic.fit_isotonic(counts)
    fitted.save(spark, str(tmp_path / "points"))
    rows = spark.createDataFrame([(0.0,), (0.15,), (0.25,), (0.6,), (2.0,), (None,)], "_score double")
    for held in (fitted, isotonic.IsotonicCalibrator.load(spark, str(tmp_path / "points"))):
        assert [r["_calibrated"] for r in held.transform(rows).collect()] == [0.0, pytest.approx(0.25), 0.5, pytest.approx(0.75), 1.0, None]
    with pytest.raises(ValueError):
        isotonic.fit_isotonic(counts.limit(0))


def test_pooling_by_ranges_keeps_the_isotonic_fit(spark):
    rng = random.Random(2)
    pairs = [(int(rng.random() < s), s) for s in (round(rng.random(), 4) for _ in range(3000))]
    counts = evaluation.score_counts(spark.createDataFrame(pairs, "label int, score double")).withColumnRenamed("score", "_score")
    few = isotonic.minorant(counts, score="_score")
    assert few.count() < counts.count() / 3 and few.agg(F.sum("total")).first()[0] == 3000

    def rates(blocks):
        out = {}
        for r in blocks.collect():  # blocks of one rate may stay apart
            p, t = out.get(round(r["positives"] / r["total"], 12), (0, 0))
            out[round(r["positives"] / r["total"], 12)] = (p + r["positives"], t + r["total"])
        return out

    assert rates(isotonic.minorant(counts, score="_score", ranges=40)) == rates(few)
    want, merged = [], []
    for score, positives, total in counts.orderBy("_score").select("_score", "positives", "total").collect():
        merged.append([positives, total, [score]])
        while len(merged) > 1 and merged[-2][0] * merged[-1][1] >= merged[-1][0] * merged[-2][1]:
            p, t, scores = merged.pop()
            merged[-1] = [merged[-1][0] + p, merged[-1][1] + t, merged[-1][2] + scores]
    for p, t, scores in merged:
        want += [(s, p / t) for s in scores]
    model = calibration.calibrate_scores(spark.createDataFrame(pairs, "label int, score double"))
    got = model.transform(counts).select("_score", "_calibrated").orderBy("_score").collect()
    assert [tuple(r) for r in got] == [(s, pytest.approx(x, abs=1e-9)) for s, x in want]


def test_medians_of_many_columns(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1.0, 2.0, None]), rng.random(), float(k), None if k else 5.0, float("inf") if k % 3 else 1.0) for k in range(501)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = preprocess.medians_and_modes(frame, preprocess.Routing(list("abcde"), []))
    for k, c in enumerate("abcde"):
        assert got[c] == np.median([r[k] for r in rows if r[k] is not None]), c
    assert preprocess.medians_and_modes(frame.limit(0), preprocess.Routing(["a"], ["b"])) == {"a": None, "b": None}


def test_configuration_files(spark, tmp_path):
    from credence.sources import config_argument, load_config

    (tmp_path / "m.json").write_text('{"logistic_regression": {"C": 0.5}}')
    (tmp_path / "l.json").write_text("[1]")
    (tmp_path / "e.json").write_text("null")
    assert load_config(str(tmp_path / "m.json")) == {"logistic_regression": {"C": 0.5}} and load_config(str(tmp_path / "e.json")) == {}
    assert config_argument('{"C": 2}') == {"C": 2}
    args = ["x", "--train-end-date", "a", "--test-start-date", "b", "--model-config", str(tmp_path / "m.json")]
    assert job.parse_args(args).model_config == {"C": 0.5}
    pytest.importorskip("yaml")
    (tmp_path / "m.yaml").write_text("column_aliases:\n  loan_status: [outcome]\n")
    assert load_config(str(tmp_path / "m.yaml")) == {"column_aliases": {"loan_status": ["outcome"]}}
    with pytest.raises(ValueError):
        load_config(str(tmp_path / "l.json"))
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none.json"))


def test_optimality_sums_before_it_deals_slots(spark):
    """The rows are summed as vectors; no row is dealt into one row per slot."""
    from credence.plans.queries import QUERIES

    found = QUERIES["lr_optimality"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") > plan.index("Generate") and all(r["optimal"] for r in found.collect())


def test_text_is_parsed_once_for_the_passes(spark):
    """Medians, scales and categories are found in columns that were parsed before, not in the texts."""
    rows = spark.createDataFrame([(f" {k} ", "ab"[k % 2], None if k % 3 else f"{k}e1", k % 2) for k in range(40)], "s string, c string, t string, default_flag int")
    parsed = spark.sparkContext.accumulator(0)

    def seen(text: str) -> str:
        parsed.add(1)
        return text

    seen = F.udf(seen).asNondeterministic()
    model = preprocess.fit_preprocessor(rows.select(seen("s").alias("s"), "c", "t"))
    assert parsed.value <= 2 * 40  # once for the routes, once for all else
    typed = preprocess.typed_columns(rows, preprocess.Routing(["s", "t"], ["c"]))
    assert dict(typed.dtypes) == {"s": "double", "t": "double", "c": "string"}
    of_text, of_typed = preprocess.fit_typed(rows.schema, typed, preprocess.Routing(["s", "t"], ["c"]))
    vectors = [m.transform(r).select(vector_to_array("features")).collect() for m, r in ((model, rows), (of_text, rows), (of_typed, typed))]
    assert vectors[0] == vectors[1] == vectors[2] and len(vectors[0][0][0]) == 4
