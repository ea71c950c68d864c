"""Default grids, both sides in the store, and two boosters that differ."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.models import training
from ledgerlens.plans import training_job
from ledgerlens.sources.store import FeatureStore


@pytest.fixture
def rows(txns):
    rng = random.Random(7)
    return txns(*[
        {
            "transactionAmount": float(rng.randint(1, 400)),
            "isFraud": rng.random() < 0.3,
            "merchantName": f"m{rng.randint(0, 5)}",
            "availableMoney": float(rng.randint(0, 900)),
            "transactionDateTime": f"2020-{1 + i // 28 % 12:02d}-{1 + i % 28:02d}T{rng.randint(0, 23):02d}:00:00",
        }
        for i in range(200)
    ])


def test_grid_is_searched_by_default(spark, rows, tmp_path, monkeypatch):
    asked = []
    search = training.grid_search
    monkeypatch.setattr(training_job, "GRIDS", {"logistic_regression": {"C": [0.5, 2.0]}})
    monkeypatch.setattr(training, "grid_search", lambda *a, **k: asked.append(a[1:3]) or search(*a, **k))
    store = FeatureStore(spark, str(tmp_path / "store"))
    training_job.train_job(rows, str(tmp_path / "a"), "logistic_regression", store=store, folds=2, threshold=0.5)
    assert asked == [("logistic_regression", {"C": [0.5, 2.0]})]
    assert store.read().count() == 200
    training_job.train_job(rows, str(tmp_path / "b"), "logistic_regression", threshold=0.5, C=1.0)
    assert len(asked) == 1


def test_boosters_differ(rows):
    from ledgerlens.plans.feature_pipeline import FeaturePipeline

    features = FeaturePipeline().fit(rows).transform(rows)
    models = training.fit_models(features, ["xgboost", "lightgbm"], num_trees=3, max_depth=4)
    scored = training.score_models(models, features)
    assert scored.where(F.abs(F.col("xgboost_score") - F.col("lightgbm_score")) > 1e-6).count() > 100
