"""Queries over splits, folds, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import profile, split
from ledgerlens.workload.evaluation import FOLD_CTE
from ledgerlens.workload.registry import coerced, register, scored, valid

RATIO_SQL = """WITH o AS (SELECT row_key, row_number() OVER (ORDER BY us, row_key) - 1 AS i, count(*) OVER () AS n FROM valid)
SELECT row_key, CAST(i >= greatest(1, least(n - 1, CAST(floor(n * 0.8) AS BIGINT))) AS INTEGER) AS is_test FROM o"""


def tagged(parts):
    train, test = parts
    return train.select("row_key", F.lit(0).alias("is_test")).unionByName(
        test.select("row_key", F.lit(1).alias("is_test"))
    )


@register("chrono_split", RATIO_SQL)
def chrono_split(spark, sf_dir):
    """The default 60-day window is longer than the data, so the ratio applies."""
    return tagged(split.chrono_split(valid(spark, sf_dir)))


@register(
    "chrono_split_days",
    "SELECT row_key, CAST(us >= (SELECT max(us) FROM valid) - 6 * 86400000000 AS INTEGER) AS is_test FROM valid",
)
def chrono_split_days(spark, sf_dir):
    return tagged(split.chrono_split(valid(spark, sf_dir), test_days=6))


@register("time_series_folds", f"WITH {FOLD_CTE.format(k=3)} SELECT row_key, fold FROM folds")
def time_series_folds(spark, sf_dir):
    return split.time_series_folds(valid(spark, sf_dir), 3).select("row_key", "fold")


@register(
    "calibration_split",
    """WITH o AS (SELECT row_key, row_number() OVER (ORDER BY us, row_key) - 1 AS i, count(*) OVER () AS n FROM valid)
    SELECT row_key, CAST(i >= CAST(floor(n * 0.8) AS BIGINT) AS INTEGER) AS is_test FROM o""",
)
def calibration_split(spark, sf_dir):
    return tagged(split.calibration_split(valid(spark, sf_dir)))


@register(
    "union_by_name",
    """SELECT row_key, merchantName, CAST(NULL AS VARCHAR) AS merchantState, 0 AS side FROM txn
    UNION ALL SELECT row_key, NULL, merchantState, 1 FROM txn""",
)
def union_by_name(spark, sf_dir):
    df = coerced(spark, sf_dir)
    left = df.select("row_key", "merchantName", F.lit(0).alias("side"))
    right = df.select("row_key", "merchantState", F.lit(1).alias("side"))
    return left.unionByName(right, allowMissingColumns=True)


@register(
    "top_entities",
    """SELECT merchantName AS segment, CAST(count(*) AS BIGINT) AS total_transactions, CAST(sum(y) AS BIGINT) AS fraud_transactions
    FROM valid GROUP BY 1 ORDER BY sum(y) DESC, merchantName LIMIT 20""",
)
def top_entities(spark, sf_dir):
    ranked = profile.top_entities(
        profile.entity_risk(scored(spark, sf_dir), "merchantName"), "fraud_transactions"
    )
    return ranked.select("segment", "total_transactions", "fraud_transactions")


@register("head_n", "SELECT row_key, customerId FROM txn ORDER BY row_key LIMIT 25")
def head_n(spark, sf_dir):
    return split.head_n(coerced(spark, sf_dir), 25, "row_key").select("row_key", "customerId")


@register("background_sample")
def background_sample(spark, sf_dir):
    return split.background_sample(
        valid(spark, sf_dir), ["merchantName", "transactionAmount", "merchantState"]
    )


@register("legit_subsample")
def legit_subsample(spark, sf_dir):
    return split.legit_subsample(scored(spark, sf_dir)).select("row_key", "isFraud", "transactionAmount")
