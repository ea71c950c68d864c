"""Explanations of tree models score their variants next to the row, with the model's own results."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.models.preprocess import fit_preprocessor
from ledgerlens.models.registry import component
from ledgerlens.models.training import FraudModel, _trainable
from ledgerlens.operators import explain

FEATURES = ["c1", "c2", "n1", "n2"]


class Counted(FraudModel):
    """Fails when variants go through the model."""

    scored = True

    def transform(self, df, output="fraud_probability"):
        if not self.scored:
            raise AssertionError("variants went through the model")
        return super().transform(df, output)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for k in range(400):
        c1, c2, n1, n2 = rng.choice("abc"), rng.choice("xy"), round(rng.uniform(-2, 2), 1), rng.choice([None, 0.0, 1.5])
        data.append((k, c1, c2, n1, n2, int((c1 == "a") + n1 * (c2 == "x") + (n2 or 0.3) + rng.gauss(0, 0.4) > 1)))
    return spark.createDataFrame(data, "row_key long, c1 string, c2 string, n1 double, n2 double, isFraud int")


@pytest.mark.parametrize("name", ["random_forest", "xgboost"])
def test_variants_equal_the_models_scores(rows, name, monkeypatch):
    p = fit_preprocessor(rows, ["c1", "c2"], ["n1", "n2"], min_count=2)
    ready = _trainable(rows.withColumn("class_weight", F.lit(1.0)), p)
    built = component(name).build(seed=3, num_trees=6, max_depth=5).setFeaturesCol("features").setLabelCol("_label").setWeightCol("_weight")
    model = Counted(name, p, built.fit(ready))
    asked = rows.where("row_key < 30")
    # Two rows with one key, and rows without any, are explained together.
    some = asked.unionByName(rows.where("row_key in (40, 41)").withColumn("row_key", F.lit(3).cast("long")))
    some = some.unionByName(rows.where("row_key in (50, 51)").withColumn("row_key", F.lit(None).cast("long")))
    some = model.transform(some).coalesce(1).localCheckpoint()
    background = rows.where("row_key >= 360").coalesce(1)

    def values():
        parts = explain.sampled_contributions(model, some, background, FEATURES)
        parts = parts.unionByName(explain.local_surrogate(model, some, background, FEATURES, samples=60, top=4))
        return {(r.row_key, r.feature, r.method): r.value for r in parts.collect()}

    model.scored = False
    got = values()
    model.scored = True
    monkeypatch.setattr(explain, "_tree_variants", lambda *a: None)
    want = values()
    assert len(want) == 31 * 4 * 2 and got.keys() == want.keys()
    # The first of two base scores of one key is any of them.
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want if k[0] is not None and k[0] != 3 or k[2] == "lime")
