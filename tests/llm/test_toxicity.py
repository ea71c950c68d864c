"""Toxicity: held-out accuracy, odd rows."""

import numpy as np
import pytest

from ledgerlens.llm.toxicity import ToxicityModel, fit_toxicity, score_toxicity
from pyspark.sql import functions as F


def rates(got, labels):
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    hit = sum(p and y for p, y in held)
    return hit / max(1, sum(y for _, y in held)), hit / max(1, sum(p for p, _ in held)), len(held)


def test_held_out_accuracy(spark):
    from ledgerlens.llm.q_toxicity import op1_toxicity

    path = "/root/testdata/sf0.1"
    labels = dict(spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "toxic").collect())
    got = op1_toxicity(spark, path).collect()
    recall, precision, n = rates(got, labels)
    assert n > 500 and recall > 0.85 and precision > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    plain = [" ".join("".join(rng.choice(list("aeiourstn"), 6)) for _ in range(60)) for _ in range(80)]
    bad = [t + " zwackzig " + "plonkfutz " * 2 for t in plain[:40]]
    return ToxicityModel.fit(bad, plain[40:])


def test_texts_of_any_kind(spark, model):
    rows = [(1, "ein ZWACKZIG, plonkfutz", "x"), (2, None, "y"), (None, "", None), (4, "nothing " * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r["doc_id"]: r["score"] for r in score_toxicity(docs, model).collect()}
    assert got[1] > 0.5 and got[2] == got[None] < 0.5 and got[4] < 0.5
    assert score_toxicity(docs.limit(0), model).collect() == []


def test_score_does_not_depend_on_the_batch(model):
    texts = ["plonkfutz and more", "x " * 2_000_000 + "zwackzig plonkfutz", "", "zwackzig"]
    assert np.allclose(model.score(texts), [model.score([t])[0] for t in texts])


def test_labels_of_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, "c")], "doc_id long, text string")
    for rows in ([], [(1, 1)], [(1, 0), (2, None), (None, 1)]):
        fitted = fit_toxicity(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert score_toxicity(docs, fitted).where(F.col("score") > 0.01).count() == 0
