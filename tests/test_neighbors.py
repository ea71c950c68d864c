"""Nearest rows through the splitting tree against brute force, and the balanced table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import kdtree, resample
from ledgerlens.operators.neighbors import nearest, vectors


def frame(spark, x, first=0):
    rows = [(first + i, *map(float, v)) for i, v in enumerate(x)]
    return vectors(spark.createDataFrame(rows, "row_key bigint, " + ", ".join(f"c{i} double" for i in range(x.shape[1]))),
                   [f"c{i}" for i in range(x.shape[1])])


def brute(queries, data, qids, ids, k):
    out = {}
    for q, qid in zip(queries, qids):
        d = np.zeros(len(data))
        for j in range(data.shape[1]):
            d += (data[:, j] - q[j]) ** 2
        order = sorted((float(v), int(i)) for v, i in zip(np.sqrt(d), ids) if i != qid)[:k]
        out |= {(qid, r + 1): (i, v) for r, (v, i) in enumerate(order)}
    return out


def found(df):
    return {(r.id, r["rank"]): (r.neighbor, r.distance) for r in df.collect()}


@pytest.mark.parametrize("shape", ["even", "clumped"])
def test_many_rounds_equal_brute_force(spark, shape):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 3)).round(2)
    if shape == "clumped":  # a third are copies of one row, one column never varies, one outlier
        x[:1000], x[:, 2], x[2999] = x[0], 7.0, 1e6
    v = frame(spark, x)
    asked = v.where("id % 7 = 0")
    tree = kdtree.place(v, asked.select(F.col("id").alias("qid"), "x"), 40) if shape == "even" else None
    if tree:
        assert tree.rounds >= 1
        assert tree.points.groupBy("node").count().agg(F.max("count")).first()[0] <= 40
    ids = np.arange(3000)
    assert found(nearest(asked, v, 2, 12)) == brute(x[::7], x, ids[::7], ids, 2)


def test_two_rounds_place_every_row_once(spark):
    v = frame(spark, np.random.default_rng(2).normal(size=(4000, 2)))
    placed = kdtree.place(v, v.select(F.col("id").alias("qid"), "x"), 8)
    assert placed.rounds == 2
    sizes = placed.points.groupBy("node").count()
    assert sizes.agg(F.sum("count"), F.max("count")).first() == (4000, sizes.agg(F.max("count")).first()[0])
    assert sizes.agg(F.max("count")).first()[0] <= 8
    same = placed.points.join(placed.asked, (F.col("id") == F.col("qid")) & (placed.points.node == placed.asked.node))
    assert same.count() == 4000


def test_queries_away_from_the_data_and_few_rows(spark):
    rng = np.random.default_rng(3)
    data, asked = rng.normal(size=(300, 2)), rng.normal(size=(20, 2)) + 50
    got = found(nearest(frame(spark, asked, 1000), frame(spark, data), 3, 16))
    assert got == brute(asked, data, range(1000, 1020), range(300), 3)
    few = np.array([[0.0, 0.0], [3.0, 4.0]])
    assert found(nearest(frame(spark, few), frame(spark, few), 5)) == {(0, 1): (1, 5.0), (1, 1): (0, 5.0)}
    none = frame(spark, few).where("id < 0")
    assert nearest(frame(spark, few), none, 1).count() == nearest(none, frame(spark, few), 1).count() == 0


def test_odd_numbers_count_as_zero(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, float("inf")), (4, 2.0)], "row_key bigint, a double")
    assert {r.x[0] for r in vectors(df, ["a"]).where("id < 4").collect()} == {0.0}


def test_task_size_does_not_grow_with_the_rows(spark):
    rng = np.random.default_rng(4)
    largest = []
    for n in (1000, 10_000):
        v = frame(spark, rng.normal(size=(n, 2)))
        placed = kdtree.place(v, v.select(F.col("id").alias("qid"), "x"), 200)
        largest.append(placed.points.groupBy("node").count().agg(F.max("count")).first()[0])
    assert max(largest) <= 200


@pytest.fixture
def mixed(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(90):
        fraud = i % 6 == 0
        place = None if i % 9 == 0 else f"p{i % 4}"
        rows.append((i, float(rng.normal()), None if i % 15 == 0 else int(rng.integers(0, 50)), place, i % 2 == 0, f"text {i}", fraud))
    return spark.createDataFrame(rows, "row_key bigint, a double, b int, place string, here boolean, note string, isFraud boolean")


def test_balanced_table_equals_its_definition(spark, mixed):
    """Every synthetic row re-derived from the neighbours by brute force."""
    table = resample.smote_table(mixed, ["a", "b"], ["place", "here"], ratio=1.0, k=3, block_rows=12)
    assert [f.dataType for f in table.schema.fields[:-1]] == [f.dataType for f in mixed.schema.fields]
    rows, old = table.where("synthetic = 1").collect(), {r.row_key: r for r in mixed.collect()}
    assert table.where("synthetic = 0").drop("synthetic").exceptAll(mixed).count() == 0
    fraud = {k: r for k, r in old.items() if r.isFraud}
    legit = len(old) - len(fraud)
    assert sorted(r.row_key for r in rows) == list(range(90, 90 + legit - len(fraud)))

    def around(r):
        by = sorted(((r.a - o.a) ** 2 + ((r.b or 0) - (o.b or 0)) ** 2, o.row_key) for o in fraud.values() if o is not r)
        return [old[k] for _, k in by[:3]]

    def vote(values):
        return max(values, key=lambda v: (values.count(v), -values.index(v)))

    plain = {(r.a,): r for r in resample.smote(mixed, ["a", "b"], ratio=1.0, k=3).collect()}
    for r in rows:
        base = fraud[plain[(r.a,)].row_key]
        assert r.isFraud and r.note is None
        assert (r.place, r.here) == (vote([o.place for o in around(base)]), vote([o.here for o in around(base)]))
        bs = [v for v in (base.b, *(o.b for o in around(base))) if v is not None]
        if r.b is None:  # only where both ends lack it
            assert base.b is None and any(o.b is None for o in around(base))
        else:
            assert min(bs) <= r.b <= max(bs)


def test_balanced_table_of_odd_tables(spark, mixed):
    enough = resample.smote_table(mixed, ["a", "b"], ["place"], ratio=0.1)
    assert enough.count() == 90 and enough.where("synthetic = 1").count() == 0
    for few in (mixed.where("row_key = 0 OR NOT isFraud"), mixed.where("NOT isFraud"), mixed.limit(0)):
        assert resample.smote_table(few, ["a"], ratio=1.0).where("synthetic = 1").count() == 0
    with pytest.raises(ValueError, match="synthetic"):
        resample.smote_table(mixed.withColumn("synthetic", F.lit(1)), ["a"])


def test_balanced_then_links_removed(spark, mixed):
    table = resample.smote_table(mixed, ["a", "b"], ["place"], ratio=1.0)
    links = {r.majority for r in resample.tomek_links(table, ["a", "b"]).collect()}
    left = resample.smote_tomek(mixed, ["a", "b"], ["place"], ratio=1.0)
    assert links
    assert {r.row_key for r in left.collect()} == {r.row_key for r in table.collect()} - links


def test_wide_rows(spark):
    x = np.random.default_rng(8).normal(size=(600, 32)).round(3)
    v = frame(spark, x)
    ids = np.arange(600)
    assert found(nearest(v.where("id % 50 = 0"), v, 2, 16)) == brute(x[::50], x, ids[::50], ids, 2)
