"""The training job: split, features, store, fit or select, score the held-out side, metrics, gate, save."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from ledgerlens.models import training
from ledgerlens.models.artifact import Artifact
from ledgerlens.operators.metrics import collect_metrics
from ledgerlens.operators.split import background_sample
from ledgerlens.plans.feature_pipeline import train_test_features
from ledgerlens.plans.scoring import ALERT_THRESHOLD, score_frame
from ledgerlens.schema import FEATURE_COLUMNS, SCHEMA_VERSION
from ledgerlens.session import checkpointed
from ledgerlens.sources.store import FeatureStore

# The promotion gate.
GATE = {"auc_pr": 0.20, "recall": 0.65}
# Grids searched by default, by model; models without one are fitted with their defaults.
GRIDS: dict[str, dict[str, Sequence[Any]]] = {
    "xgboost": {"max_depth": [6, 8], "num_trees": [80, 120]},
    "lightgbm": {"max_depth": [6, 8], "num_trees": [80, 120]},
    "random_forest": {"max_depth": [12, 16], "min_samples_leaf": [5, 10]},
    "logistic_regression": {"C": [0.5, 1.0, 2.0]},
    "catboost": {"C": [0.5, 1.0, 2.0]},
}


def train_job(
    raw: DataFrame,
    path: str,
    model_name: str = "xgboost",
    *,
    store: FeatureStore | None = None,
    grid: Mapping[str, Sequence[Any]] | None = None,
    folds: int = 3,
    fit: Callable[[DataFrame], Any] | None = None,
    threshold: float = ALERT_THRESHOLD,
    gate: Mapping[str, float] = GATE,
    test_days: int = 60,
    seed: int = 42,
    **params: Any,
) -> Artifact:
    """Train on ``raw`` and save one artifact below ``path``.

    ``fit`` gives the model from the training features (a stack, for example). Otherwise ``grid`` is searched over
    ``folds`` expanding folds: the model's own of ``GRIDS`` if none is given, unless ``params`` say what to fit or
    the grid given is empty. A ``store`` gets the features of both sides. ``facts`` of the artifact hold the metrics of the held-out side and ``passed``: a failed gate is told, the artifact is
    saved all the same, and the caller decides on promotion.
    """
    both, pipeline = train_test_features(raw, test_days)
    both = checkpointed(both)
    train, test = both.where("is_test = 0"), both.where("is_test = 1")
    if store is not None:
        store.write(train.drop("is_test"))
        store.append(test.drop("is_test"), batch="held-out")
    if grid is None and not params:
        grid = GRIDS.get(model_name)
    if fit is not None:
        model = fit(train)
    elif grid:
        model = training.grid_search(train, model_name, dict(grid), folds, seed).model
    else:
        model = training.fit_model(train, model_name, seed, **params)
    metrics = collect_metrics(score_frame(model, test, threshold), threshold).first().asDict()
    facts = {
        "model_name": model_name,
        "schema_version": SCHEMA_VERSION,
        "threshold": threshold,
        "metrics": {k: None if v is None else float(v) for k, v in metrics.items()},
        "passed": all((metrics.get(k) or 0.0) >= least for k, least in gate.items()),
    }
    artifact = Artifact(model, pipeline, background_sample(train, FEATURE_COLUMNS), facts)
    artifact.save(path)
    return artifact
