"""Lookups: the small side is broadcast by what was measured, and rows are not shuffled on it."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.models.preprocess import fit_preprocessor
from ledgerlens.operators.encoding import encoder_apply, encoder_fit
from ledgerlens.operators.lookup import BROADCAST_BYTES, part_bytes


@pytest.fixture(scope="module")
def rows(spark):
    merchant = F.concat(F.lit("merchant-"), F.col("id").cast("string"))
    kind = F.element_at(F.array(*map(F.lit, ("a", "b", None))), (F.col("id") % 3 + 1).cast("int"))
    return spark.range(1_000_000).select(
        merchant.alias("merchantName"), kind.alias("transactionType"), (F.col("id") % 3 == 1).alias("isFraud")
    )


@pytest.fixture(autouse=True)
def measured_only(spark):
    """Without the planner's own rule, which goes by the size of compressed files."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_million_merchants_and_three_types(spark, rows):
    names = ["merchantName", "transactionType"]
    encoders = encoder_fit(rows, names)
    assert encoders.sizes["merchantName"] > BROADCAST_BYTES > 1000 > encoders.sizes["transactionType"]
    out = encoder_apply(rows, encoders, names)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [transactionType" in plan and "BroadcastHashJoin [merchantName" not in plan
    assert "SortMergeJoin [merchantName" in plan
    moved = re.findall(r"Exchange hashpartitioning\((\w+)", out._jdf.queryExecution().executedPlan().toString())
    assert moved and not any(name.startswith("transactionType") for name in moved)
    # A null value has no partner and gets the overall rate.
    got = {r.transactionType: r.f for r in out.groupBy("transactionType").agg(F.max("transactionType_fraud_rate").alias("f")).collect()}
    assert got == {"a": 0.0, "b": 1.0, None: pytest.approx(1 / 3, abs=1e-5)}


def test_vocabulary_of_each_category_is_measured(spark, rows):
    few = rows.where("length(merchantName) < 13").withColumn("x", F.lit(1.0))
    ready = fit_preprocessor(few, ["merchantName", "transactionType"], ["x"], min_count=1)
    assert set(ready.sizes) == {"merchantName", "transactionType"}
    plan = ready.transform(few)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_sizes_count_text_and_rows(spark):
    df = spark.createDataFrame([("e", "ab"), ("e", None), ("f", "ü" * 10)], "part string, value string")
    assert part_bytes(df, "part", "value") == {"e": 130, "f": 84}
    assert part_bytes(df.limit(0), "part", "value") == {}
