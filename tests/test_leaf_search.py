"""A leaf search sums few distances in full."""

import numpy as np
import pandas as pd
import pytest

from ledgerlens.operators import neighbors


@pytest.mark.parametrize("kind", ["spread", "grid", "far"])
def test_leaf_search_finds_the_same_rows_with_few_full_sums(kind, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 12))
    x = np.round(x) if kind == "grid" else x + 1e8 if kind == "far" else x
    d = pd.DataFrame({"id": np.arange(900) * 2, "x": list(x)})
    q = pd.DataFrame({"id": np.arange(70), "x": list(x[:70] + (0.25 if kind == "spread" else 0))})
    want = []
    for i, row in enumerate(q["x"]):
        distance = np.zeros(900)
        for j in range(12):
            distance += (row[j] - x[:, j]) ** 2
        distance = np.sqrt(distance)
        want += [(i, int(c) * 2, distance[c]) for c in np.argsort(distance, kind="stable")[:4]]
    held, pick = [], neighbors._in_question
    monkeypatch.setattr(neighbors, "_in_question", lambda *a: held.append(pick(*a)) or held[-1])
    got = neighbors.best_of(q, d, 4)
    assert list(got.itertuples(index=False, name=None)) == want
    assert sum(h.sum() for h in held) < 70 * 900 / 10
