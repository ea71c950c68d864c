"""Ranks of many groups at once, against sorted lists, and the percentiles built on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import profile, scan


def table(spark, seed=1, n=4000):
    rng = np.random.default_rng(seed)
    v = np.concatenate([np.zeros(n // 3), rng.normal(size=n // 3).round(1), rng.lognormal(0, 8, size=n - 2 * (n // 3))])
    rng.shuffle(v)
    rows = [(None if i % 7 == 3 else i % 3, None if i % 11 == 5 else float(x)) for i, x in enumerate(v)]
    return rows, spark.createDataFrame(rows, "g int, v double")


@pytest.mark.parametrize(("small", "buckets"), [(10, 4), (50, 64), (200_000, 2048)])
def test_ranks_of_all_groups(spark, small, buckets):
    rows, df = table(spark)
    groups, at = scan.order_statistics(
        df, "v", lambda g, n: [0, n // 2, n // 2, n - 1, (g or 0) + 5], by=F.col("g"), small=small, buckets=buckets
    )
    assert set(groups) == {None, 0, 1, 2}
    for g, row in groups.items():
        line = sorted(v for h, v in rows if h == g and v is not None)
        assert row.n == len(line)
        for r in (0, len(line) // 2, len(line) - 1, (g or 0) + 5):
            hit = at[g, r]
            assert (hit.value, hit.before, hit.equal) == (line[r], line.index(line[r]), line.count(line[r]))


def test_large_whole_numbers_and_shared_times(spark):
    base = 2**62
    rows = [(base + i % 5, base + (i * 7919) % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "_us bigint, _ord bigint")
    ranks = [0, 1, 199, 200, 500, 998, 999]
    for small in (20, 200_000):
        assert scan.nth_keys(df, "_us", "_ord", ranks, small=small, buckets=8) == [sorted(rows)[r] for r in ranks]


def test_ranks_outside_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1.0)], "g int, v double")
    with pytest.raises(ValueError, match="rank"):
        scan.order_statistics(df, "v", lambda g, n: [1])
    with pytest.raises(ValueError, match="rank"):
        scan.nth_keys(df.limit(0).selectExpr("bigint(g) a", "bigint(v) b"), "a", "b", [0])
    groups, at = scan.order_statistics(df.where("g > 1"), "v", lambda g, n: [0], by=F.col("g"))
    assert (groups, at) == ({}, {})


def test_number_of_jobs_does_not_grow_with_the_ranks(spark, monkeypatch):
    _, df = table(spark)
    passes = []
    narrowed = scan._narrowed
    monkeypatch.setattr(scan, "_narrowed", lambda *a: passes.append(len(a[1])) or narrowed(*a))
    for many in (1, 40):
        passes.clear()
        scan.order_statistics(df, "v", lambda g, n, m=many: [i * (n - 1) // m for i in range(m)], by=F.col("g"), small=900)
        assert len(passes) <= 1


def test_percentiles_equal_the_grouped_form(spark):
    _, df = table(spark, 2)
    got = profile.describe(df, "v", F.col("g"))
    expected = df.groupBy(F.col("g").alias("label")).agg(F.percentile("v", F.array(*map(F.lit, profile.PERCENTILES))).alias("q"))
    quantiles = {r.label: r.q for r in expected.collect()}
    assert {r["label"]: [r[profile._percent(p)] for p in profile.PERCENTILES] for r in got.collect()} == quantiles
    assert "ObjectHashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    many = df.withColumn("g", F.monotonically_increasing_id() % 40)
    assert profile.describe(many, "v", F.col("g")).count() == 40
    empty = profile.describe(df.where("v IS NULL AND g = 1"), "v", F.col("g")).first()
    assert (empty["count"], empty["p50"], empty["min"]) == (0, None, None)
