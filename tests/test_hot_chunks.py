"""Chunks of the hot-key path: found by halving, and no more of them than the largest entity needs."""

from pyspark.sql import functions as F

from ledgerlens.operators import history as h
from ledgerlens.operators.scan import fixed_edges, with_chunk


def test_chunk_is_the_number_of_edges_at_or_below(spark):
    rows = spark.createDataFrame([(v,) for v in [None, -5, 0, 1, 2, 3, 9, 10, 11, 10**12]], "v bigint")
    for edges in ([], [3], [1, 1, 2, 10], list(range(0, 1022, 2))):
        literal = F.array(*map(F.lit, edges)).cast("array<bigint>")
        got = {r["v"]: r["_chunk"] for r in with_chunk(rows, "v", literal).collect()}
        assert got == {v: sum(v is not None and e <= v for e in edges) for v in got}
    none = with_chunk(rows, "v", F.lit(None).cast("array<bigint>"))
    assert {r["_chunk"] for r in none.collect()} == {0}
    # One comparison per binary digit, not one per edge.
    plan = with_chunk(rows, "v", F.array(F.lit(3)))._jdf.queryExecution().analyzed().toString()
    assert "filter(" not in plan


def fullest(points, edges):
    counts = with_chunk(points, "_us", edges).groupBy("_key", "_chunk").count()
    return counts.agg(F.max("count")).first()[0]


def test_few_chunks_for_many_small_entities(spark):
    points = spark.range(6000).select(
        (F.col("id") % 500).cast("string").alias("_key"), (F.col("id") * 1000).alias("_us")
    )
    edges = h._few_edges(points, 4, 512)
    assert points.select(F.size(edges)).first()[0] < 20
    assert fullest(points, edges) <= 4


def test_an_entity_in_a_short_time_gets_more_chunks(spark):
    spread = spark.range(4000).select((F.col("id") % 400).cast("string").alias("_key"), (F.col("id") * 1000).alias("_us"))
    dense = spark.range(50).select(F.lit("dense").alias("_key"), (F.col("id") + 2_000_000).alias("_us"))
    points = spread.unionByName(dense)
    assert fullest(points, fixed_edges(points, "_us", 8)) > 25
    assert fullest(points, h._few_edges(points, 25, 512)) <= 25
