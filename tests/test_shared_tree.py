"""Tomek links grow one tree for both of their searches."""

import numpy as np

from ledgerlens.operators import neighbors, resample


def test_one_tree_for_both_searches(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3)).round(1) * np.array([1.0, -1.0, 0.0])  # copies, and zeros of either sign
    fraud = rng.random(300) < 0.4
    rows = [(i, *map(float, v), bool(y)) for i, (v, y) in enumerate(zip(x, fraud))]
    df = spark.createDataFrame(rows, "row_key bigint, a double, b double, c double, isFraud boolean")
    grown, grow = [], neighbors.grow
    monkeypatch.setattr(neighbors, "grow", lambda *a: grown.append(a[1]) or grow(*a))
    got = {tuple(r) for r in resample.tomek_links(df, ["a", "b", "c"], block_rows=16).collect()}
    apart = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    first = apart.argmin(axis=1)  # the smaller key among equals
    want = {(i, int(first[i])) for i in range(300) if fraud[i] and not fraud[first[i]] and first[first[i]] == i}
    assert got == want and len(want) > 5
    assert grown == [16]
