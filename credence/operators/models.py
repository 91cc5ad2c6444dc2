"""Classifiers: penalised logistic regression on Spark ML, and boosted trees."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from credence.operators.boosting import fit_boosted_trees
from credence.operators.categories import CategoryEncoder
from credence.operators.preprocess import fit_typed, route_columns, typed_columns

# The default parameters of both kinds of models.
LOGISTIC = {"C": 1.0, "max_iter": 1000, "class_weight": "balanced", "random_state": 42}
BOOSTED = {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.05, "subsample": 0.8, "colsample_bytree": 0.8,
           "objective": "binary:logistic", "eval_metric": "aucpr", "random_state": 42}

#: Further parameters that Spark's logistic regression has.
LOGISTIC_MORE = {"penalty": "l2", "l1_ratio": None, "fit_intercept": True, "tol": 1e-8}
#: Further parameters that Spark's boosted trees have.
BOOSTED_MORE = {"eta": None, "min_child_weight": 1, "gamma": 0.0, "max_bin": 32, "scale_pos_weight": 1.0}
#: Parameters that say how a library works, not what it fits: accepted and unused.
UNUSED = ("n_jobs", "verbose", "verbosity", "warm_start", "solver", "tree_method", "device", "seed", "nthread", "booster")


def _settings(defaults: Mapping[str, Any], more: Mapping[str, Any], config: Mapping[str, Any] | None) -> dict[str, Any]:
    if config is not None and not isinstance(config, Mapping):
        raise ValueError("Model configuration must be a mapping.")
    known = {**more, **defaults}
    unknown = sorted(set(config or {}) - set(known) - set(UNUSED))
    if unknown:
        raise ValueError(f"Spark's models have no such parameters: {unknown}; they have {sorted(known)}.")
    return {**known, **(config or {})}


def class_weights(rows: DataFrame, label: str = "default_flag") -> DataFrame:
    """(label, total, weight): rows / (2 * rows of the class)."""
    counts = rows.groupBy(F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("total"))
    total = rows.select(F.count(F.lit(1)).alias("rows")).scalar()
    return counts.withColumn("weight", total / (2 * F.col("total")))


def _weighted(rows: DataFrame, label: str, weights: str | Mapping | None) -> tuple[DataFrame, float]:
    """Rows with `_weight`, and the sum of the weights."""
    found = {r["label"]: r for r in class_weights(rows, label).collect()}  # two rows
    if set(found) != {0, 1}:
        raise ValueError("Training requires both classes.")
    if weights == "balanced":
        by_class = {k: r["weight"] for k, r in found.items()}
    else:
        by_class = {k: float((weights or {}).get(k, 1.0)) for k in found}
    total = float(sum(r["total"] * by_class[k] for k, r in found.items()))
    return rows.withColumn("_weight", F.when(F.col(label) == 1, F.lit(by_class[1])).otherwise(F.lit(by_class[0]))), total


def _fitted(train: DataFrame, label: str, routing: dict, prepare, fit) -> PipelineModel:
    """Preprocessing and a model; what is needed is held for the passes over it, and so are the rows that `prepare` makes for `fit`.

    `stored`: the rows are a table, which is not held as it is for its two passes.
    """
    exclude, stored = (label, *routing.pop("exclude", ())), routing.pop("stored", False)
    needed = train.select(label, *[F.col(f"`{c}`") for c in train.columns if c not in exclude])
    held = [] if stored else [needed.persist(StorageLevel.MEMORY_AND_DISK)]
    try:
        routed = route_columns(needed, exclude=(label,), **routing)
        held.append(typed := typed_columns(needed, routed, keep=(label,)).persist(StorageLevel.MEMORY_AND_DISK))
        preprocessor, own = fit_typed(needed.schema, typed, routed)
        if not stored:
            held.pop(0).unpersist()
        held.append(rows := prepare(own, typed).persist(StorageLevel.MEMORY_AND_DISK))
        return PipelineModel([*preprocessor.stages, fit(rows, preprocessor.stages[-1])])
    finally:
        for one in held:
            one.unpersist()


def train_logistic_regression(train: DataFrame, *, config: Mapping[str, Any] | None = None, label: str = "default_flag", **routing) -> PipelineModel:
    """Penalised, the intercept not penalised; C as in half the square plus C times the loss.

    penalty: l2, l1, elasticnet (with l1_ratio) or None. class_weight: balanced, None or a
    mapping of class to weight.
    """
    params = _settings(LOGISTIC, LOGISTIC_MORE, config)
    weights, penalty = params["class_weight"], params["penalty"]
    if weights not in ("balanced", None) and not isinstance(weights, Mapping):
        raise ValueError("class_weight must be `balanced`, None or a mapping.")
    if penalty not in ("l1", "l2", "elasticnet", None):
        raise ValueError("penalty must be l1, l2, elasticnet or None.")
    share = {"l1": 1.0, "elasticnet": params["l1_ratio"] or 0.0}.get(penalty, 0.0)

    def vectors(preprocessor: PipelineModel, rows: DataFrame) -> DataFrame:
        return preprocessor.transform(rows).select(label, "features")

    def fit(rows: DataFrame, encoder: CategoryEncoder):
        weighted, total = _weighted(rows, label, weights)
        return LogisticRegression(labelCol=label, weightCol="_weight", regParam=1 / (params["C"] * total) if penalty else 0.0, elasticNetParam=share,
                                  standardization=False, fitIntercept=params["fit_intercept"], maxIter=params["max_iter"], tol=params["tol"]).fit(weighted)

    return _fitted(train, label, routing, vectors, fit)


def train_boosted_trees(train: DataFrame, *, config: Mapping[str, Any] | None = None, label: str = "default_flag", **routing) -> PipelineModel:
    """Gradient-boosted trees on logistic loss; objective and eval_metric are accepted and unused."""
    params = _settings(BOOSTED, BOOSTED_MORE, config)

    def slots(preprocessor: PipelineModel, rows: DataFrame) -> DataFrame:
        dealt, encoder = preprocessor.stages
        numbered, numbers = encoder.numbered(dealt.transform(rows))
        return numbered.select(label, *encoder.getOrDefault("numericCols"), *numbers)

    def fit(rows: DataFrame, encoder: CategoryEncoder):
        numeric = encoder.getOrDefault("numericCols")
        asked = GBTClassifier(labelCol=label, maxIter=params["n_estimators"], maxDepth=params["max_depth"],
                              stepSize=params["learning_rate"] if params["eta"] is None else params["eta"],
                              subsamplingRate=params["subsample"], featureSubsetStrategy=str(params["colsample_bytree"]), seed=params["random_state"],
                              minInstancesPerNode=max(1, int(params["min_child_weight"])), minInfoGain=float(params["gamma"]), maxBins=params["max_bin"])
        return fit_boosted_trees(rows, asked, numeric=numeric, numbers=rows.columns[1 + len(numeric):], sizes=encoder.getOrDefault("sizes"),
                                 positive=float(params["scale_pos_weight"]))

    return _fitted(train, label, routing, slots, fit)


TRAINERS = {"logistic_regression": train_logistic_regression, "xgboost": train_boosted_trees, "boosted_trees": train_boosted_trees}


def train_model(train: DataFrame, model_type: str = "logistic_regression", **options) -> PipelineModel:
    if model_type not in TRAINERS:
        raise ValueError(f"Unknown model type; there are {sorted(TRAINERS)}.")
    return TRAINERS[model_type](train, **options)


def score(model: Any, rows: DataFrame, *, keep: tuple[str, ...] = ("default_flag",)) -> DataFrame:
    """`keep` and default_probability, the chance of the positive class."""
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias("default_probability"))
