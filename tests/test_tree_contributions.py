"""Contributions of tree models against all subsets of six features."""

import random
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.models.preprocess import fit_preprocessor
from ledgerlens.models.registry import component
from ledgerlens.models.training import FraudModel, _trainable
from ledgerlens.operators.tree_explain import TreeExplainer, tree_contributions

WORDS, NUMBERS = ["c1", "c2"], ["n1", "n2", "n3", "n4"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    data = []
    for k in range(600):
        c1, c2, *n = rng.choice("abcd"), rng.choice("xyz"), *(round(rng.uniform(-2, 2), 1) for _ in range(4))
        odds = 2 * (c1 == "a") - (c2 == "x") * n[0] + n[1] * n[2] + (n[3] > 0) * (c1 == "b")
        data.append((k, c1, c2, *[v if rng.random() > 0.03 else None for v in n], int(odds + rng.gauss(0, 0.5) > 0.5)))
    return spark.createDataFrame(data, "row_key long, c1 string, c2 string, n1 double, n2 double, n3 double, n4 double, isFraud int")


def fitted(rows, name, **params):
    p = fit_preprocessor(rows, WORDS, NUMBERS, min_count=2)
    ready = _trainable(rows.withColumn("class_weight", F.lit(1.0)), p)
    estimator = component(name).build(seed=3, **params).setFeaturesCol("features").setLabelCol("_label").setWeightCol("_weight")
    return FraudModel(name, p, estimator.fit(ready))


def brute(spark, model, some, background, margin):
    """Shapley values by scoring every mixture of a row with every background row."""
    names = [*WORDS, *NUMBERS]
    subsets = [frozenset(c) for size in range(7) for c in combinations(names, size)]
    mine, theirs = some.collect(), background.collect()
    mixed = [
        (f"{r['row_key']}|{s}|{b}", *[r[n] if n in chosen else back[n] for n in names])
        for r in mine for s, chosen in enumerate(subsets) for b, back in enumerate(theirs)
    ]
    table = spark.createDataFrame(mixed, "row_key string, c1 string, c2 string, n1 double, n2 double, n3 double, n4 double")
    value = {}
    for r in model.transform(table).select("row_key", "fraud_probability").collect():
        key, s, _ = r[0].split("|")
        p = min(max(r[1], 1e-15), 1 - 1e-15)
        value.setdefault((int(key), int(s)), []).append(0.5 * np.log(p / (1 - p)) if margin else p)
    at = {s: i for i, s in enumerate(subsets)}
    out = {}
    for r in mine:
        for n in names:
            total = 0.0
            for s in subsets:
                if n not in s:
                    share = factorial(len(s)) * factorial(5 - len(s)) / factorial(6)
                    total += share * (np.mean(value[r["row_key"], at[s | {n}]]) - np.mean(value[r["row_key"], at[s]]))
            out[r["row_key"], n] = total
    return out


@pytest.mark.parametrize("name, params, margin", [("random_forest", {"num_trees": 4, "max_depth": 6}, False), ("xgboost", {"num_trees": 4, "max_depth": 4}, True)])
def test_matches_all_subsets(spark, rows, name, params, margin):
    model = fitted(rows, name, **params)
    some, background = rows.where("row_key < 6"), rows.where("row_key >= 100 and row_key < 109")
    got = {(r["row_key"], r["feature"]): r["value"] for r in tree_contributions(model, some, background).collect()}
    want = brute(spark, model, some, background, margin)
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_sums_are_score_minus_mean(spark, rows):
    model = fitted(rows, "random_forest", num_trees=20, max_depth=10)
    background = rows.where("row_key % 10 = 0")
    explainer = TreeExplainer.of(model, background)
    mean = model.transform(background).agg(F.avg("fraud_probability")).first()[0]
    assert abs(explainer.base() - mean) < 1e-9
    total = {r[0]: r[1] for r in explainer.contributions(rows).groupBy("row_key").agg(F.sum("value")).collect()}
    scores = {r[0]: r[1] for r in model.transform(rows).select("row_key", "fraud_probability").collect()}
    assert len(total) == 600 and max(abs(total[k] - (scores[k] - mean)) for k in scores) < 1e-9
    assert explainer.contributions(rows.limit(0)).collect() == []


def test_background_is_checked(rows):
    model = fitted(rows, "random_forest", num_trees=2, max_depth=2)
    with pytest.raises(ValueError, match="background"):
        TreeExplainer.of(model, rows.limit(0))


def test_largest_of_a_row_are_the_first_of_explain_frame(rows):
    model = fitted(rows, "random_forest", num_trees=4, max_depth=4)
    some, explainer = rows.limit(40), TreeExplainer.of(model, rows.where("row_key >= 560"))
    every = {}
    for r in explainer.contributions(some).collect():
        every.setdefault(r.row_key, []).append((-abs(r.value), r.feature, r.value))
    found = explainer.contributions(some, top=3).collect()
    got = {}
    for r in found:
        got.setdefault(r.row_key, set()).add((r.feature, r.value))
    assert len(found) == 120 and got == {k: {c[1:] for c in sorted(v)[:3]} for k, v in every.items()}
