"""Calibration: reliability curves, and post-hoc calibration of a fitted model's scores."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.operators.evaluation import score_counts
from credence.operators.isotonic import fit_isotonic
from credence.operators.prefix import Profile, profile, running_totals


def order_statistics(counts: DataFrame, ranks: list[int], known: Profile | None = None) -> dict[int, float]:
    """The values at these ranks from 0, from a table of distinct values and counts."""
    over = running_totals(counts, "score", {"until": "total"}, known=known)
    wanted = F.filter(F.array(*[F.lit(r).cast("bigint") for r in sorted(set(ranks))]),
                      lambda r: (r < F.col("until")) & (r >= F.col("until") - F.col("total")))
    found = over.select("score", wanted.alias("ranks")).filter(F.size("ranks") > 0).collect()  # one row per rank at most
    return {r: row["score"] for row in found for r in row["ranks"]}


def quantile_edges(counts: DataFrame, n_bins: int) -> list[float]:
    """n_bins + 1 edges by linear interpolation; ranks are integers, so that an edge that is
    a data value is that value exactly."""
    known = profile(counts, "score", ("total",))
    n = known.sums["total"]
    if not n:
        return []
    places = [divmod(i * (n - 1), n_bins) for i in range(n_bins + 1)]
    values = order_statistics(counts, [r for k, rest in places for r in (k, k + (rest > 0))], known)
    edges = []
    for k, rest in places:
        low, high = values[k], values[k + (rest > 0)]
        edges.append(low if low == high else low + (high - low) * (rest / n_bins))
    return edges


def calibration_curve(counts: DataFrame, *, n_bins: int = 10) -> DataFrame:
    """Mean score and observed rate of quantile bins, ascending; empty bins are left out.

    A score on an inner edge belongs to the lower bin.
    """
    inner = quantile_edges(counts, n_bins)[1:-1]
    bin_ = F.size(F.filter(F.array(*[F.lit(e) for e in inner]), lambda e: e < F.col("score"))) if inner else F.lit(0)
    score = F.when((F.col("score") < 0) | (F.col("score") > 1), F.raise_error("A score is outside 0 to 1.").cast("double")).otherwise(F.col("score"))
    return (counts.groupBy(bin_.alias("bin")).agg(
        (F.sum(score * F.col("total")) / F.sum("total")).alias("mean_predicted_probability"),
        (F.sum("positives") / F.sum("total")).alias("observed_default_rate"))
        .orderBy("bin").drop("bin"))


@dataclass
class CalibratedModel:
    """A fitted model and a map of its scores to calibrated probabilities."""

    model: Any
    calibrator: Any
    method: str
    use_margin: bool

    def transform(self, rows: DataFrame, output: str = "default_probability") -> DataFrame:
        scored = self.model.transform(rows).withColumn("_score", _raw_score(self.use_margin))
        if self.method == "isotonic":
            out = self.calibrator.transform(scored).withColumn(output, F.col("_calibrated"))
        else:
            out = VectorAssembler(inputCols=["_score"], outputCol="_margin").transform(scored)
            out = self.calibrator.transform(out).withColumn(output, vector_to_array("_calibrated")[1])
        return out.drop("_score", "_margin", "_calibrated", "_raw", "_predicted")


def _raw_score(use_margin: bool):
    return vector_to_array(F.col("rawPrediction" if use_margin else "probability"))[1]


def calibrate_scores(scored: DataFrame, *, method: str = "isotonic", label: str = "label", score: str = "score") -> Any:
    """A calibrator of column `_score` fitted on distinct scores with weights.

    isotonic: constant beyond the ends, linear between points. sigmoid: logistic in the
    score, targets smoothed by the class sizes, each distinct score as one row per class.
    """
    if method not in ("isotonic", "sigmoid"):
        raise ValueError("Unknown calibration method; there are `isotonic` and `sigmoid`.")
    counts = score_counts(scored, label, score).withColumnRenamed("score", "_score")
    if method == "isotonic":
        return fit_isotonic(counts, score="_score")
    sums = counts.agg(F.sum("positives").alias("p"), F.sum("total").alias("n")).first()
    p, n = sums["p"] or 0, sums["n"] or 0
    high, low = (p + 1) / (p + 2), 1 / (n - p + 2)
    weight = F.col("positives") * F.lit(high) + (F.col("total") - F.col("positives")) * F.lit(low)
    rows = counts.select("_score", F.lit(1.0).alias("target"), weight.alias("weight")).union(
        counts.select("_score", F.lit(0.0), F.col("total") - weight))
    rows = VectorAssembler(inputCols=["_score"], outputCol="_margin").transform(rows)
    return LogisticRegression(featuresCol="_margin", labelCol="target", weightCol="weight", probabilityCol="_calibrated", rawPredictionCol="_raw",
                              predictionCol="_predicted", regParam=0.0, standardization=True, maxIter=200, tol=1e-10).fit(rows)


def calibrate_model(model: Any, rows: DataFrame, *, method: str = "isotonic", label: str = "default_flag",
                    use_margin: bool | None = None) -> CalibratedModel:
    """Calibrate a fitted model on rows it was not fitted on.

    The calibrator sees the margin of a logistic model and the probability of any other.
    """
    if method not in ("isotonic", "sigmoid"):
        raise ValueError("Unknown calibration method; there are `isotonic` and `sigmoid`.")
    if use_margin is None:
        use_margin = "LogisticRegression" in type(getattr(model, "stages", [model])[-1]).__name__
    scored = model.transform(rows).select(F.col(label).alias("label"), _raw_score(use_margin).alias("score"))
    return CalibratedModel(model, calibrate_scores(scored, method=method), method, use_margin)
