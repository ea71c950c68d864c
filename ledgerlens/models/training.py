"""Fitting, grid search, stacking and calibration on feature tables."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import label
from ledgerlens.models.isotonic import calibrate_isotonic  # noqa: F401
from ledgerlens.models.preprocess import Preprocessor, fit_preprocessor
from ledgerlens.models.registry import ANOMALY, LINEAR, component
from ledgerlens.operators.encoding import class_weights
from ledgerlens.operators.metrics import average_precision, minmax_score, score_range
from ledgerlens.operators.split import fold_parts, time_series_folds
from ledgerlens.schema import NUMERIC_FEATURES
from ledgerlens.session import checkpointed

KINDS = {
    "GBTClassificationModel": GBTClassificationModel,
    "RandomForestClassificationModel": RandomForestClassificationModel,
    "LogisticRegressionModel": LogisticRegressionModel,
}


def _probability(df: DataFrame, name: str) -> DataFrame:
    scored = df.withColumn(name, vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def weighted(df: DataFrame) -> DataFrame:
    """0/1 double label for estimators, and balanced weights where none are given."""
    df = df if "class_weight" in df.columns else class_weights(df)
    return df.withColumn("_label", label(F.col("isFraud")).cast("double"))


@dataclass
class FraudModel:
    """A fitted preprocessor and classifier; ``transform`` adds the probability column."""

    name: str
    preprocessor: Preprocessor
    classifier: Any

    def transform(self, df: DataFrame, output: str = "fraud_probability") -> DataFrame:
        return _probability(self.classifier.transform(self.preprocessor.transform(df)), output)


def _estimator(name: str, params: dict, seed: int, ready: DataFrame):
    if name in LINEAR:
        params = {**params, "weight_sum": ready.agg(F.sum("_weight")).first()[0] or 0.0}
    built = component(name).build(seed=seed, **params)
    return built.setFeaturesCol("features").setLabelCol("_label").setWeightCol("_weight")


def _trainable(df: DataFrame, preprocessor: Preprocessor) -> DataFrame:
    ready = preprocessor.transform(weighted(df).withColumn("_weight", F.col("class_weight")))
    return ready.select("features", "_label", "_weight")


def fit_model(
    train: DataFrame,
    name: str = "xgboost",
    seed: int = 42,
    extra_numeric: Sequence[str] = (),
    **params: Any,
) -> FraudModel:
    """Fit one supervised component on a feature table (class weights included).

    Its vectors are stored: every estimator reads them several times.
    """
    preprocessor = fit_preprocessor(train, numeric=[*NUMERIC_FEATURES, *extra_numeric])
    ready = checkpointed(_trainable(train, preprocessor))
    return FraudModel(name, preprocessor, _estimator(name, params, seed, ready).fit(ready))


def fit_models(
    train: DataFrame,
    names: Sequence[str],
    seed: int = 42,
    extra_numeric: Sequence[str] = (),
    **params: Any,
) -> dict[str, FraudModel]:
    """Fit several components on one preprocessed table."""
    preprocessor = fit_preprocessor(train, numeric=[*NUMERIC_FEATURES, *extra_numeric])
    ready = checkpointed(_trainable(train, preprocessor))
    return {n: FraudModel(n, preprocessor, _estimator(n, params, seed, ready).fit(ready)) for n in names}


def score_models(models: dict[str, FraudModel], df: DataFrame) -> DataFrame:
    """Add ``{name}_score`` of models that share a preprocessor, preprocessing once."""
    ready = next(iter(models.values())).preprocessor.transform(df)
    for name, model in models.items():
        scored = model.classifier.transform(ready)
        ready = scored.withColumn(f"{name}_score", vector_to_array("probability")[1]).drop(
            "rawPrediction", "probability", "prediction"
        )
    return ready.drop("features")


# -- model selection -----------------------------------------------------------


@dataclass
class GridResult:
    best: dict[str, Any]
    scores: list[tuple[dict[str, Any], list[float]]]
    model: FraudModel = field(repr=False)


def grid_search(
    train: DataFrame, name: str, grid: dict[str, Sequence[Any]], k: int = 3, seed: int = 42
) -> GridResult:
    """Average precision over k expanding folds per parameter set, then a refit of the best.

    The preprocessor is fitted inside each fold and its output shared by all parameter sets.
    """
    folded = time_series_folds(train, k)
    candidates = [dict(zip(grid, values)) for values in product(*grid.values())]
    scores: list[tuple[dict[str, Any], list[float]]] = [(c, []) for c in candidates]
    for i in range(1, k + 1):
        fit_part, held = fold_parts(folded, i)
        preprocessor = fit_preprocessor(fit_part)
        ready = checkpointed(_trainable(fit_part, preprocessor))
        target = checkpointed(_trainable(held, preprocessor))
        for params, results in scores:
            model = _estimator(name, params, seed, ready).fit(ready)
            predicted = _probability(
                model.transform(target).withColumn("isFraud", F.col("_label").cast("int")), "fraud_probability"
            )
            results.append(float(average_precision(predicted).first()[0]))
    best = max(scores, key=lambda entry: sum(entry[1]))[0]
    return GridResult(best, scores, fit_model(train, name, seed, **best))


# -- stacks ----------------------------------------------------------------------


@dataclass
class AnomalyScore:
    """An anomaly model with its training range; high means unusual."""

    model: Any
    low: float
    high: float

    def transform(self, df: DataFrame, output: str) -> DataFrame:
        raw = self.model.transform(df, "_raw_score")
        return raw.withColumn(output, minmax_score(F.col("_raw_score"), self.low, self.high)).drop("_raw_score")


def fit_anomaly(train: DataFrame, name: str, seed: int = 42, **params: Any) -> AnomalyScore:
    model = component(name).build(seed=seed, **params)(train, NUMERIC_FEATURES)
    return AnomalyScore(model, *score_range(model.transform(train, "_raw_score"), "_raw_score"))


def fit_meta(df: DataFrame, columns: Sequence[str]):
    """Balanced linear model over score columns; a single-class table gives its constant rate."""
    low, high = df.agg(F.min(label(F.col("isFraud"))), F.max(label(F.col("isFraud")))).first()
    if low == high:
        return Constant(float(low or 0))
    ready = VectorAssembler(inputCols=list(columns), outputCol="features").transform(
        weighted(df.drop("class_weight"))
    )
    estimator = LogisticRegression(
        maxIter=100, regParam=1e-4, featuresCol="features", labelCol="_label", weightCol="class_weight"
    )
    return MetaModel(list(columns), estimator.fit(ready.select("features", "_label", "class_weight")))


@dataclass
class Constant:
    rate: float

    def transform(self, df: DataFrame, output: str = "fraud_probability") -> DataFrame:
        return df.withColumn(output, F.lit(self.rate))


@dataclass
class MetaModel:
    columns: list[str]
    classifier: LogisticRegressionModel

    def transform(self, df: DataFrame, output: str = "fraud_probability") -> DataFrame:
        ready = VectorAssembler(inputCols=self.columns, outputCol="features").transform(df)
        return _probability(self.classifier.transform(ready), output)


@dataclass
class StackedModel:
    """Anomaly scores feed boosters; booster scores feed the meta model."""

    anomaly: dict[str, Any]
    boosters: dict[str, FraudModel]
    meta: Any

    def transform(self, df: DataFrame, output: str = "fraud_probability") -> DataFrame:
        for name, model in self.anomaly.items():
            df = model.transform(df, f"{name}_score")
        return self.meta.transform(score_models(self.boosters, df), output)


# The parts of the stack.
STACK_ANOMALY = ["isolation_forest", "one_class_svm", "autoencoder", "tabtransformer"]
STACK_BOOSTERS = ["xgboost", "lightgbm"]


def fit_stacked(
    train: DataFrame, seed: int = 42, k: int = 3, out_of_fold: bool = True, **params: Any
) -> StackedModel:
    """Four anomaly-stage scores, two boosters on top, a meta model on the booster scores.

    By default the meta model learns from out-of-fold booster scores; ``out_of_fold=False`` uses
    in-sample scores.
    """
    anomaly: dict[str, Any] = {}
    for i, name in enumerate(STACK_ANOMALY):
        if name in ANOMALY:
            anomaly[name] = fit_anomaly(train, name, seed + i, **params)
        else:
            anomaly[name] = fit_model(train, name, seed, **params)
    columns = [f"{n}_score" for n in anomaly]
    staged = train
    for name, model in anomaly.items():
        staged = model.transform(staged, f"{name}_score")
    staged = checkpointed(staged)
    if out_of_fold:
        held = oof_scores(staged, STACK_BOOSTERS, k, seed, columns, **params)
    boosters = fit_models(staged, STACK_BOOSTERS, seed, columns, **params)
    if not out_of_fold:
        held = score_models(boosters, staged)
    return StackedModel(anomaly, boosters, fit_meta(held, [f"{n}_score" for n in boosters]))


def oof_scores(
    train: DataFrame,
    names: Sequence[str],
    k: int,
    seed: int = 42,
    extra_numeric: Sequence[str] = (),
    **params: Any,
) -> DataFrame:
    """Validation rows of every expanding fold with each model's ``{name}_score``."""
    folded = checkpointed(time_series_folds(train, k))
    out = None
    for i in range(1, k + 1):
        fit_part, held = fold_parts(folded, i)
        held = score_models(fit_models(fit_part, names, seed, extra_numeric, **params), held)
        out = held if out is None else out.unionByName(held)
    return out


def fit_stacking_oof(
    train: DataFrame, names: Sequence[str] = ("random_forest", "logistic_regression"), k: int = 5, **params: Any
) -> StackedModel:
    """Out-of-fold predictions of base models feed a linear meta model."""
    held = checkpointed(oof_scores(train, names, k, **params))
    base = fit_models(train, names, **params)
    return StackedModel({}, base, fit_meta(held, [f"{n}_score" for n in names]))


# -- calibration -------------------------------------------------------------------


def calibrate_platt(held: DataFrame, score: str = "fraud_probability"):
    """Sigmoid of the score fitted on held-out rows (no regularisation, no weights)."""
    ready = VectorAssembler(inputCols=[score], outputCol="features").transform(
        held.withColumn("_label", label(F.col("isFraud")).cast("double"))
    )
    return MetaModel([score], LogisticRegression(labelCol="_label", maxIter=100).fit(ready))


# -- persistence -------------------------------------------------------------------


def save_model(model: FraudModel, path: str, metadata: dict[str, Any] | None = None) -> None:
    """Classifier, preprocessor and metadata below one folder."""
    p = model.preprocessor
    spark = p.vocabulary.sparkSession
    model.classifier.write().overwrite().save(f"{path}/classifier")
    p.stages.write().overwrite().save(f"{path}/stages")
    p.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    facts = {
        "name": model.name,
        "kind": type(model.classifier).__name__,
        "categorical": p.categorical,
        "numeric": p.numeric,
        "slots": p.slots,
        "metadata": metadata or {},
    }
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/model"
    )


def load_model(spark: SparkSession, path: str) -> tuple[FraudModel, dict[str, Any]]:
    """(model, metadata) from the folder :func:`save_model` wrote, or from its ``model`` entry."""
    root = re.sub(r"/model(/[^/]*)?$", "", path.rstrip("/"))
    facts = json.loads(spark.read.text(f"{root}/model").first()[0])
    preprocessor = Preprocessor(
        facts["categorical"],
        facts["numeric"],
        spark.read.parquet(f"{root}/vocabulary"),
        facts["slots"],
        PipelineModel.load(f"{root}/stages"),
    )
    classifier = KINDS[facts["kind"]].load(f"{root}/classifier")
    return FraudModel(facts["name"], preprocessor, classifier), facts["metadata"]
