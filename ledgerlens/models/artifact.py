"""One folder for a fitted model of any kind, with what a scoring job needs beside it."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.models.isolation import IsolationForest
from ledgerlens.models.isotonic import IsotonicCalibration, IsotonicTable
from ledgerlens.models.reconstruction import ReconstructionError
from ledgerlens.models.training import (
    AnomalyScore,
    Constant,
    FraudModel,
    MetaModel,
    StackedModel,
    load_model,
    save_model,
)
from ledgerlens.plans.feature_pipeline import FeaturePipeline


def _write(spark: SparkSession, path: str, facts: dict) -> None:
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def save_any(spark: SparkSession, model: Any, path: str) -> None:
    """Write a fitted model of any kind below ``path``; parts of composed models go to folders of their own."""
    facts: dict[str, Any] = {"kind": type(model).__name__}
    if isinstance(model, FraudModel):
        save_model(model, f"{path}/part")
    elif isinstance(model, StackedModel):
        facts |= {"anomaly": list(model.anomaly), "boosters": list(model.boosters)}
        for group in ("anomaly", "boosters"):
            for name, part in getattr(model, group).items():
                save_any(spark, part, f"{path}/{group}/{name}")
        save_any(spark, model.meta, f"{path}/meta")
    elif isinstance(model, AnomalyScore):
        facts |= {"low": model.low, "high": model.high}
        save_any(spark, model.model, f"{path}/part")
    elif isinstance(model, IsolationForest):
        facts |= {"columns": model.columns, "sample_rows": model.sample_rows}
        spark.createDataFrame(model.nodes).write.mode("overwrite").parquet(f"{path}/nodes")
    elif isinstance(model, ReconstructionError):
        facts |= {"columns": model.columns}
        model.stages.write().overwrite().save(f"{path}/stages")
    elif isinstance(model, MetaModel):
        facts |= {"columns": model.columns}
        model.classifier.write().overwrite().save(f"{path}/classifier")
    elif isinstance(model, IsotonicCalibration):
        facts |= {"score": model.score}
        model.model.write().overwrite().save(f"{path}/model")
    elif isinstance(model, IsotonicTable):
        facts |= {"score": model.score}
        model.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    elif isinstance(model, Constant):
        facts |= {"rate": model.rate}
    else:
        raise TypeError(f"cannot save a {type(model).__name__}")
    _write(spark, f"{path}/facts", facts)


def load_any(spark: SparkSession, path: str) -> Any:
    """The model that :func:`save_any` wrote."""
    facts = _read(spark, f"{path}/facts")
    kind = facts["kind"]
    if kind == "FraudModel":
        return load_model(spark, f"{path}/part")[0]
    if kind == "StackedModel":
        groups = [{n: load_any(spark, f"{path}/{g}/{n}") for n in facts[g]} for g in ("anomaly", "boosters")]
        return StackedModel(*_share(groups), load_any(spark, f"{path}/meta"))
    if kind == "AnomalyScore":
        return AnomalyScore(load_any(spark, f"{path}/part"), facts["low"], facts["high"])
    if kind == "IsolationForest":
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas()
        return IsolationForest(facts["columns"], nodes, facts["sample_rows"], spark)
    if kind == "ReconstructionError":
        return ReconstructionError(facts["columns"], PipelineModel.load(f"{path}/stages"))
    if kind == "MetaModel":
        return MetaModel(facts["columns"], LogisticRegressionModel.load(f"{path}/classifier"))
    if kind == "IsotonicCalibration":
        return IsotonicCalibration(facts["score"], IsotonicRegressionModel.load(f"{path}/model"))
    if kind == "IsotonicTable":
        return IsotonicTable(facts["score"], spark.read.parquet(f"{path}/blocks"))
    if kind == "Constant":
        return Constant(facts["rate"])
    raise ValueError(f"unknown model kind {kind!r} in {path}")


def _share(groups: list[dict]) -> list[dict]:
    """Boosters of a stack share one preprocessor, as when they were fitted."""
    boosters = list(groups[1].values())
    for model in boosters[1:]:
        model.preprocessor = boosters[0].preprocessor
    return groups


@dataclass
class Artifact:
    """A model with its encoders, the background for explanations, and facts such as threshold and metrics."""

    model: Any
    pipeline: FeaturePipeline
    background: DataFrame
    facts: dict[str, Any]

    def save(self, path: str) -> None:
        spark = self.background.sparkSession
        save_any(spark, self.model, f"{path}/fitted")
        self.pipeline.save(f"{path}/pipeline")
        self.background.write.mode("overwrite").parquet(f"{path}/background")
        _write(spark, f"{path}/facts", self.facts)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Artifact:
        return cls(
            load_any(spark, f"{path}/fitted"),
            FeaturePipeline.load(spark, f"{path}/pipeline"),
            spark.read.parquet(f"{path}/background"),
            _read(spark, f"{path}/facts"),
        )
