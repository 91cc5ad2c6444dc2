"""Evaluation of scored rows: exact ranking metrics, threshold costs.

Everything but the threshold table derives from one table of counts per distinct score,
the only wide shuffle. A scored frame has a label (0 or 1) and a score.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.operators.prefix import Profile, profile, running_totals

THRESHOLDS = tuple(round(k / 100, 2) for k in range(1, 100))


@dataclass(frozen=True)
class CostMatrix:
    false_negative_cost: float = 5.0
    false_positive_cost: float = 1.0


@dataclass(frozen=True)
class ClassificationMetrics:
    auc_roc: float
    average_precision: float
    ks_statistic: float
    brier_score: float
    default_rate: float
    approval_rate: float

    def as_dict(self) -> dict[str, float]:
        return asdict(self)


def score_counts(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, total, positives) of each distinct score; a missing label or score is an error."""
    value, flag = F.col(score).cast("double"), F.col(label).cast("bigint")
    checked = F.when(value.isNull() | F.isnan(value), F.raise_error("A score is missing.").cast("double")).otherwise(value)
    positive = F.when(flag.isNull(), F.raise_error("A label is missing.").cast("bigint")).otherwise(flag)
    # 0.0 is added so that -0.0 and 0.0 are one score
    return scored.groupBy((checked + F.lit(0.0)).alias("score")).agg(F.count(F.lit(1)).alias("total"), F.sum(positive).alias("positives"))


def score_profile(counts: DataFrame) -> Profile:
    """Rows, sums and range boundaries of a table of counts, in one pass."""
    return profile(counts, "score", ("total", "positives"))


def ranked(counts: DataFrame, known: Profile | None = None) -> DataFrame:
    """Counts with `above` and `above_positives`: totals at this score and higher."""
    return running_totals(counts, "score", {"above": "total", "above_positives": "positives"}, descending=True, known=known)


def _classes(known: Profile, what: str | None = None) -> tuple[int, int]:
    """Positives and negatives; `what` needs both."""
    p = known.sums["positives"]
    n = known.sums["total"] - p
    if what and (not p or not n):
        raise ValueError(f"{what} is not defined with one class only.")
    return p, n


def _auc(known: Profile):
    p, n = _classes(known, "AUC")
    wins = F.sum((F.col("total") - F.col("positives")) * (2 * F.col("above_positives") - F.col("positives")))
    return (wins / F.lit(2.0) / F.lit(float(p)) / F.lit(float(n))).alias("auc_roc")


def _ks(known: Profile):
    p, n = _classes(known, "KS statistic")
    gap = F.abs(F.col("above_positives") / F.lit(float(p)) - (F.col("above") - F.col("above_positives")) / F.lit(float(n)))
    return F.max(gap).alias("ks_statistic")


def _ap(known: Profile):
    p, _ = _classes(known)
    step = F.col("positives") / F.lit(float(max(p, 1))) * F.col("above_positives") / F.col("above")
    return F.coalesce(F.sum(step), F.lit(0.0)).alias("average_precision")


def _brier():
    score = F.when((F.col("score") < 0) | (F.col("score") > 1), F.raise_error("A score is outside 0 to 1.").cast("double")).otherwise(F.col("score"))
    squares = F.col("positives") * F.pow(score - 1, 2) + (F.col("total") - F.col("positives")) * F.pow(score, 2)
    return (F.sum(squares) / F.sum("total")).alias("brier_score")


def _rate():
    return (F.sum("positives") / F.sum("total")).alias("default_rate")


def auc_roc(counts: DataFrame) -> DataFrame:
    """Exact area under the ROC curve; ties count one half."""
    known = score_profile(counts)
    return ranked(counts, known).agg(_auc(known))


def ks_statistic(counts: DataFrame) -> DataFrame:
    """Largest distance of the cumulative class rates; equal scores are one step."""
    known = score_profile(counts)
    return ranked(counts, known).agg(_ks(known))


def average_precision(counts: DataFrame) -> DataFrame:
    """Sum of precision times the step in recall; 0 without positives."""
    known = score_profile(counts)
    return ranked(counts, known).agg(_ap(known))


def precision_recall(counts: DataFrame) -> DataFrame:
    """One row per distinct score as threshold, ascending, and last the end point without one.

    Without positives the recall is 1 throughout.
    """
    known = score_profile(counts)
    p, _ = _classes(known)
    over = ranked(counts, known)
    ap = over.agg(_ap(known))
    recall = F.col("above_positives") / F.lit(float(p)) if p else F.lit(1.0)
    points = over.select(F.col("score").alias("threshold"), (F.col("above_positives") / F.col("above")).alias("precision"), recall.alias("recall"))
    end = counts.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    one = F.broadcast(ap.withColumn("_one", F.lit(1)))
    return points.union(end).withColumn("_one", F.lit(1)).join(one, "_one").drop("_one").orderBy(F.asc_nulls_last("threshold"))


def brier_score(counts: DataFrame) -> DataFrame:
    """Mean squared distance of score and label, as a weighted sum over distinct scores."""
    return counts.agg(_brier())


def default_rate(counts: DataFrame) -> DataFrame:
    return counts.agg(_rate())


def threshold_costs(scored: DataFrame, *, cost_matrix: CostMatrix = CostMatrix(), thresholds: Iterable[float] | None = None,
                    label: str = "label", score: str = "score") -> DataFrame:
    """Confusion counts, rates and cost of each threshold, in the caller's order.

    One pass: a row falls into the bucket of how many thresholds its score reaches, and the
    table is running totals over at most one bucket per threshold. A missing score reaches
    none; a missing label is an error.
    """
    given = [float(t) for t in (THRESHOLDS if thresholds is None else thresholds)]
    if not given:
        raise ValueError("No thresholds were given.")
    steps = sorted(set(given))
    value, flag = F.col(score).cast("double"), F.col(label).cast("bigint")
    reach = F.when(value.isNull() | F.isnan(value), F.lit(0)).otherwise(
        F.size(F.filter(F.array(*[F.lit(t) for t in steps]), lambda t: t <= value)))
    positive = F.when(flag.isNull(), F.raise_error("A label is missing.").cast("bigint")).otherwise(flag)
    buckets = scored.groupBy(reach.alias("reach")).agg(F.count(F.lit(1)).alias("rows"), F.sum(positive).alias("positives"))
    # from here on at most one row per threshold and one more, times the thresholds it reaches
    spark = scored.sparkSession
    none = spark.createDataFrame([(k, 0, 0) for k in range(len(steps) + 1)], "least int, rows bigint, positives bigint")
    reached = (buckets.select(F.explode(F.sequence(F.lit(0), "reach")).alias("least"), "rows", "positives").union(none)
               .groupBy("least").agg(F.sum("rows").alias("reach_rows"), F.sum("positives").alias("true_positives")))
    all_rows = Window.partitionBy(F.lit(0))
    reached = reached.withColumns({"rows": F.max("reach_rows").over(all_rows), "positives": F.max("true_positives").over(all_rows)})
    table = spark.createDataFrame([(k, t, steps.index(t) + 1) for k, t in enumerate(given)], "place int, threshold double, least int")
    totals = table.join(F.broadcast(reached), "least").withColumn("false_positives", F.col("reach_rows") - F.col("true_positives"))
    tp, fp = F.col("true_positives"), F.col("false_positives")
    fn, tn = F.col("positives") - tp, F.col("rows") - F.col("positives") - fp
    return totals.orderBy("place").select(
        "threshold", tp, fp, tn.alias("true_negatives"), fn.alias("false_negatives"),
        ((tp + fp) / F.col("rows")).alias("predicted_default_rate"), ((tn + fn) / F.col("rows")).alias("approval_rate"),
        (fn * F.lit(float(cost_matrix.false_negative_cost)) + fp * F.lit(float(cost_matrix.false_positive_cost))).alias("total_cost"))


def selected_threshold(costs: DataFrame) -> DataFrame:
    """The row of least cost, of equal ones that of the lowest threshold."""
    return costs.orderBy("total_cost", "threshold").limit(1)


def _all_metrics(counts: DataFrame) -> DataFrame:
    """The five metrics of the scores in one aggregation over the ranked counts."""
    known = score_profile(counts)
    return ranked(counts, known).agg(_auc(known), _ap(known), _ks(known), _brier(), _rate())


def classification_metrics(counts: DataFrame, chosen: DataFrame) -> ClassificationMetrics:
    """All six metrics; `chosen`: the selected threshold's row."""
    row = metrics_report(counts, chosen).first().asDict()
    return ClassificationMetrics(**{k: row[k] for k in ClassificationMetrics.__dataclass_fields__})


def metrics_report(counts: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: the six metrics, the chosen threshold and its cost."""
    costs = chosen.select("approval_rate", F.col("threshold").alias("selected_threshold"), F.col("total_cost").alias("selected_threshold_total_cost"))
    # one row each
    return (_all_metrics(counts).withColumn("_one", F.lit(1)).join(F.broadcast(costs.withColumn("_one", F.lit(1))), "_one").drop("_one"))
