"""Ranked search against scores of every document."""

import re

import numpy as np
import pytest

from ledgerlens.llm import best_position as B
from ledgerlens.llm.best_position import ranked_search, weight

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, k):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, t in held:
            m = 100 - 75 + (75 * len(t) * n) // total
            score = sum(weight(n, df[w]) * ((10**9 * t.count(w)) // (1000 * t.count(w) + 8 * m)) for w in terms(text) if w in df)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block, shard, cells", [(1 << 16, 1 << 23, 1 << 25), (40, 300, 200)])
def test_matches_brute_force(spark, monkeypatch, block, shard, cells):
    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(B, "SHARD_BYTES", shard)
    monkeypatch.setattr(B, "SHARD_CELLS", cells)
    rng = np.random.default_rng(2)
    vocabulary = ["the", "The", "É", "é", "o", "x1", "naïve"] + [f"w{k}" for k in range(60)]
    shares = 1 / np.arange(1, len(vocabulary) + 1)
    text = lambda n: rng.choice([" ", ", ", "-\n", "\x00"]).join(rng.choice(vocabulary, n, p=shares / shares.sum()).tolist())
    docs = [(int(k), text(int(rng.integers(0, 60)))) for k in rng.permutation(300)]
    docs += [(300 + k, docs[3][1]) for k in range(15)] + [(None, docs[5][1]), (400, None), (401, ""), (402, " !? "), (403, "w1 " * 3000)]
    items = [(k, text(int(rng.integers(1, 25)))) for k in range(20)] + [(50, None), (51, ""), (52, "absent"), (53, "w1 w1 w1 w9 é É")]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, score string, rank int").repartition(3)
    asked = spark.createDataFrame([(*r, 1) for r in items + items[:2]], "item_id long, text string, doc_id int")
    for k in (1, 10):
        assert sorted((tuple(r) for r in ranked_search(frame, asked, k).collect()), key=str) == sorted(plain(docs, items, k), key=str)
    assert ranked_search(frame.limit(0), asked).collect() == []
    assert ranked_search(frame, asked.limit(0)).collect() == []


def test_stops_early():
    """A shard is left before its lists are read to the end once nothing unseen can reach the k-th score."""
    rng = np.random.default_rng(3)
    n, met = 4000, []
    impact = np.sort(rng.integers(1, 1 << 20, 2 * n))[::-1]
    shard = B.Shard(2, np.arange(n), np.repeat([0, 1], n), np.concatenate([np.arange(n), np.arange(n)]), impact)
    inner = B.best
    B.best = lambda s, i, k: met.append(len(s)) or inner(s, i, k)
    try:
        scores, ids = shard.search(np.array([0, 1]), np.array([1, 2]), 10, np.zeros(0, np.int64), np.zeros(0, np.int64))
    finally:
        B.best = inner
    totals = impact[:n] + 2 * impact[n:]
    assert ids.tolist() == np.lexsort((np.arange(n), -totals))[:10].tolist() and scores.tolist() == totals[ids].tolist()
    assert sum(met) < n // 4


def test_query_matches_sql(spark):
    import duckdb

    from ledgerlens.llm.q_ranked import SQL, op12_ranked_search

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet')")
    assert sorted(tuple(r) for r in op12_ranked_search(spark, path).collect()) == sorted(con.sql(SQL).fetchall())
