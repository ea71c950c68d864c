"""Isotonic calibration in chunks against one pass over all points."""

import random

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from ledgerlens.models.artifact import load_any, save_any
from ledgerlens.models.isotonic import IsotonicCalibration, IsotonicTable, calibrate_isotonic, isotonic_blocks


def one_pass(rows):
    """Blocks (low, high, mean) by the minimax formula: largest over starts of the least mean over ends."""
    scores = sorted({x for x, _ in rows})
    ones = np.array([sum(y for s, y in rows if s == x) for x in scores], float)
    n = np.array([sum(s == x for s, _ in rows) for x in scores], float)
    a, b = np.concatenate([[0], ones.cumsum()]), np.concatenate([[0], n.cumsum()])
    m = len(scores)
    return scores, [
        max(min((a[j + 1] - a[i]) / (b[j + 1] - b[i]) for j in range(k, m)) for i in range(k + 1)) for k in range(m)
    ]


def cases():
    rng = random.Random(3)
    noisy = [(round(x, 2), int(rng.random() < x)) for x in (rng.random() for _ in range(400))]
    falling = [(i / 50, int(i < 25)) for i in range(50)]
    rising = [(i / 60, int(i * 7 % 60 < i)) for i in range(60)]
    heavy = [(i / 40, int(rng.random() < i / 40)) for i in range(40)] + [(1.0, 0)] * 300
    return {"noisy": noisy, "falling": falling, "rising": rising, "heavy low end": heavy, "one": [(0.5, 1)], "equal": [(0.1 * i, 1) for i in range(9)]}


@pytest.mark.parametrize("name", cases())
@pytest.mark.parametrize("chunk", [2, 7, 1000])
def test_equals_one_pass(spark, name, chunk):
    rows = cases()[name]
    if chunk == 2 and name == "noisy":
        rows = rows[:60]
    held = spark.createDataFrame(rows, "x double, y int")
    points = held.groupBy("x").agg(F.sum("y").alias("ones"), F.count("y").alias("n"))
    blocks = isotonic_blocks(points, chunk).orderBy("low").collect()
    means = [b.ones / b.n for b in blocks]
    assert means == sorted(set(means))
    scores, want = one_pass(rows)
    got = [next(b.ones / b.n for b in blocks if b.low <= x <= b.high) for x in scores]
    assert got == pytest.approx(want)


def test_model_and_table_agree_with_the_estimator(spark, tmp_path):
    rows = cases()["noisy"] + [(None, 1), (float("nan"), 0)]
    held = spark.createDataFrame([(i, x, bool(y)) for i, (x, y) in enumerate(rows)], "row_key long, p double, isFraud boolean")
    model, stored = calibrate_isotonic(held, "p", chunk=20), calibrate_isotonic(held, "p", chunk=20, model_blocks=0)
    assert isinstance(model, IsotonicCalibration) and isinstance(stored, IsotonicTable)
    save_any(spark, stored, str(tmp_path / "table"))
    stored = load_any(spark, str(tmp_path / "table"))
    asked = spark.createDataFrame([(-1.0,), (0.0,), (0.123,), (0.5,), (0.5,), (0.777,), (0.9999,), (2.0,)], "p double")
    points = held.where("p is not null and not isnan(p)").selectExpr("p as f", "cast(isFraud as double) as label")
    plain = IsotonicRegression(featuresCol="f").fit(points)
    want = [r.prediction for r in plain.transform(asked.withColumn("f", F.col("p"))).orderBy("p").collect()]
    assert [r.calibrated for r in model.transform(asked).orderBy("p").collect()] == pytest.approx(want)
    assert [r.calibrated for r in stored.transform(asked).orderBy("p").collect()] == pytest.approx(want)
    nulls = stored.transform(held).where("p is null").collect()
    assert [r.calibrated for r in nulls] == [None] and stored.transform(held).count() == len(rows)
