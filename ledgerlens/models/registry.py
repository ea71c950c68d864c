"""Model components by name: what each is for, and how its Spark ML estimator is built."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier


@dataclass(frozen=True)
class Component:
    name: str
    role: str
    production_status: str
    notes: str
    build: Callable[..., Any]

    def metadata(self) -> dict[str, str]:
        facts = asdict(self)
        facts.pop("build")
        return facts


def boosted(seed: int = 42, **p: Any) -> GBTClassifier:
    return GBTClassifier(
        maxIter=int(p.get("num_trees", 120)),
        maxDepth=int(p.get("max_depth", 8)),
        maxBins=int(p.get("max_bins", 64)),
        stepSize=float(p.get("learning_rate", 0.05)),
        subsamplingRate=float(p.get("subsample", 0.8)),
        minInstancesPerNode=int(p.get("min_child_weight", 5)),
        seed=seed,
    )


def light_boosted(seed: int = 42, **p: Any) -> GBTClassifier:
    """Shallower trees on smaller samples with larger leaves and a subset of the inputs per split, so that its errors
    differ from those of ``boosted``."""
    own = {"max_depth": max(2, int(p.get("max_depth", 8)) - 2), "subsample": 0.6, "min_child_weight": 20, "learning_rate": 0.08}
    built = boosted(seed + 101, **{**p, **own, **{k: v for k, v in p.items() if k not in ("max_depth",)}})
    return built.setFeatureSubsetStrategy("onethird")


def forest(seed: int = 42, **p: Any) -> RandomForestClassifier:
    return RandomForestClassifier(
        numTrees=int(p.get("num_trees", 300)),
        maxDepth=int(p.get("max_depth", 16)),
        maxBins=int(p.get("max_bins", 64)),
        minInstancesPerNode=int(p.get("min_samples_leaf", 5)),
        featureSubsetStrategy="sqrt",
        seed=seed,
    )


def logistic(seed: int = 42, **p: Any) -> LogisticRegression:
    """``C`` is the usual inverse strength: the penalty is weighed against the summed loss of all rows, whose
    total weight is ``weight_sum`` (Spark averages the loss)."""
    strength = 1.0 / (float(p.get("C", 1.0)) * max(float(p["weight_sum"]), 1e-9))
    return LogisticRegression(
        maxIter=int(p.get("max_iter", 100)), regParam=strength, elasticNetParam=0.0, standardization=True
    )


def isolation(seed: int = 42, **p: Any) -> Callable:
    from ledgerlens.models.isolation import fit_isolation_forest

    trees = int(p.get("num_trees", 200))
    return lambda df, columns: fit_isolation_forest(df, columns, trees=trees, seed=seed)


def low_rank(seed: int = 42, **p: Any) -> Callable:
    from ledgerlens.models.reconstruction import fit_reconstruction

    return lambda df, columns: fit_reconstruction(df, columns, rank=int(p.get("rank", 8)))


COMPONENTS: dict[str, Component] = {
    c.name: c
    for c in [
        Component("logistic_regression", "linear reference", "available", "One weight per input; cheap to explain.", logistic),
        Component("random_forest", "tree reference", "available", "Bagged trees.", forest),
        Component("xgboost", "main booster", "available", "Slot filled by gradient-boosted trees.", boosted),
        Component("lightgbm", "second booster", "available", "Gradient-boosted trees: shallower, more random.", light_boosted),
        Component("catboost", "linear alternative", "available", "Slot filled by the linear model.", logistic),
        Component("isolation_forest", "unlabelled outliers", "available", "Random split trees, no labels.", isolation),
        Component("one_class_svm", "unlabelled outliers", "available", "Slot filled by low-rank reconstruction error.", low_rank),
        Component("autoencoder", "unlabelled outliers", "available", "Slot filled by random split trees.", isolation),
        Component("tabtransformer", "tree alternative", "available", "Slot filled by bagged trees.", forest),
        Component("stacking_ensemble", "combination", "available", "Out-of-fold stack of forest and linear model.", None),
    ]
}
ANOMALY = ["isolation_forest", "one_class_svm", "autoencoder"]
LINEAR = ["logistic_regression", "catboost"]
TREES = ["xgboost", "random_forest", "lightgbm", "tabtransformer"]


def component(name: str) -> Component:
    if name not in COMPONENTS:
        raise ValueError(f"unknown model component {name!r}; available: {', '.join(COMPONENTS)}")
    return COMPONENTS[name]


def available_components() -> list[dict[str, str]]:
    return [c.metadata() for c in COMPONENTS.values()]
