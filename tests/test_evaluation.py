import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import metrics as m
from ledgerlens.operators import scan, split


def scores(spark, pairs):
    return spark.createDataFrame([(int(y), float(p)) for y, p in pairs], "isFraud int, fraud_probability double")


def test_single_class_gives_zero(spark):
    row = m.collect_metrics(scores(spark, [(0, 0.2), (0, 0.9)]), 0.5).first()
    assert (row.auc_roc, row.auc_pr, row.precision, row.recall) == (0.0, 0.0, 0.0, 0.0)
    assert (row.false_positives, row.true_negatives) == (1, 1)


def test_tied_scores_count_half(spark):
    assert m.roc_auc(scores(spark, [(1, 0.5), (0, 0.5)])).first()[0] == 0.5


def test_areas_match_brute_force(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    row = m.collect_metrics(scores(spark, zip(y, p)), 0.5).first()
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    ap, recall = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = (p >= t) & (y == 1)
        ap += (hit.sum() / len(pos) - recall) * hit.sum() / (p >= t).sum()
        recall = hit.sum() / len(pos)
    assert row.auc_roc == pytest.approx(auc) and row.auc_pr == pytest.approx(ap)


def keyed(spark, n):
    return spark.range(n).select(
        F.col("id").alias("row_key"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7919 % 97).alias("event_ts"),
    )


@pytest.mark.parametrize("small", [5, 50_000])
def test_nth_keys_is_exact(spark, small):
    rows = [(int(i * 31 % 17), int(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "_us bigint, _ord bigint")
    ranks = [0, 7, 99, 199]
    assert scan.nth_keys(df, "_us", "_ord", ranks, small=small, buckets=4) == [sorted(rows)[r] for r in ranks]


def test_split_by_ratio_and_folds(spark):
    df = keyed(spark, 50)
    train, test = split.chrono_split(df)
    assert (train.count(), test.count()) == (40, 10)
    assert train.agg(F.max("event_ts")).first()[0] <= test.agg(F.min("event_ts")).first()[0]
    counts = dict(split.time_series_folds(df, 3).groupBy("fold").count().collect())
    assert counts == {0: 14, 1: 12, 2: 12, 3: 12}
    with pytest.raises(ValueError):
        split.time_series_folds(df.limit(2), 3)


def test_hash_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_key")
    first, again = (sorted(r[0] for r in split.hash_sample(df, 200, "row_key").collect()) for _ in range(2))
    assert len(first) == 200 and first == again
    assert split.hash_sample(df.limit(5), 10, "row_key").count() == 5


def test_running_total_in_chunks(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).cast("bigint").alias("one"))
    assert all(r.n == r.k + 1 for r in scan.running_total(df, "k", {"n": "one"}).collect())
