"""Periodic runs against brute force, and the grammar's extensions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from ledgerlens.llm import periodic_runs as P
from ledgerlens.llm.periodic_runs import Grammar, periodic_runs


def plain(words, least=24):
    """All runs, by the definition."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e > s and e + q - s >= max(least, 3 * q):
                found.setdefault((s, e + q - s), q)
            s = max(e, s) + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def dropped(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(rng, letters, n):
    words = [rng.choice(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        q = rng.choice([1, 1, 2, 3, 5, 7, 8, 9, 12, 20])
        base = [rng.choice(letters) for _ in range(q)]
        cut = rng.randint(0, len(words))
        words[cut:cut] = (base * 40)[: rng.randint(2 * q, max(30, 4 * q))]
    return words


@pytest.mark.parametrize("grid", [1 << 20, 7])
def test_matches_brute_force(spark, monkeypatch, grid):
    monkeypatch.setattr(P, "GRID", grid)
    monkeypatch.setattr(P, "CHUNK", 2000)
    rng = random.Random(grid)
    texts = [periodic(rng, ["a", "b", "cé", "dd"][: rng.randint(1, 4)], rng.randint(0, 160)) for _ in range(150)]
    texts += [["x"] * 23, ["x"] * 24, ["x"] * 200, ["x", "y"] * 11 + ["x"], ["x", "y"] * 12, [str(i % 50) for i in range(150)], [str(i % 50) for i in range(149)]]
    for t, w in enumerate(texts):
        got = P.chunk_runs([" ".join(w).encode()])
        assert [tuple(r) for r in got.get(0, np.zeros((0, 3), int)).tolist()] == plain(w), (t, w)
    rows = [(i, rng.choice([" ", "\n\t ", "  "]).join(w)) for i, w in enumerate(texts)] + [(None, " a" * 30 + " "), (5, None), (6, ""), (7, " \x0b\n ")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, runs string, n_words int")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(docs).collect())
    want = sorted((i is None, i or 0, len(w), plain(w), dropped(w, plain(w))) for i, w in ((i, (t or "").split()) for i, t in rows))
    assert got == want
    assert periodic_runs(docs.limit(0)).collect() == []


@pytest.mark.parametrize("least", [1, 5, 11])
def test_other_lengths(least):
    rng = random.Random(least)
    for _ in range(60):
        words = periodic(rng, ["a", "b"], rng.randint(0, 60))
        got = P.chunk_runs([" ".join(words).encode()], least).get(0, np.zeros((0, 3), int))
        assert [tuple(r) for r in got.tolist()] == plain(words, least)


def test_extensions():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, k, n) for k, n in ((2, 300), (1, 70), (3, 40), (2, 1), (2, 0), (50, 500))]
    grammar = Grammar(texts)
    for t, text in enumerate(texts[:3]):
        i, j = (x.ravel() for x in np.meshgrid(np.arange(len(text)), np.arange(len(text))))
        i, j = i[i < j], j[i < j]
        base = grammar.place[t]
        ahead, back = grammar.extension(base + i, base + j, True), grammar.extension(base + i, base + j, False)
        for a, b, x, y in zip(i.tolist(), j.tolist(), ahead.tolist(), back.tolist()):
            k = 0
            while b + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            m = 0
            while a - m >= 0 and text[a - m] == text[b - m]:
                m += 1
            assert (k, m) == (x, y)


def test_long_periodic_text():
    words = [str(i % 3000) for i in range(60_000)]
    got = P.chunk_runs([" ".join(words).encode(), ("w " * 50_000).encode()])
    assert got[0].tolist() == [[0, 60_000, 3000]] and got[1].tolist() == [[0, 50_000, 1]]


def test_query(spark):
    from ledgerlens.llm.q_runs import op13_periodic_runs

    path = "/root/testdata/sf0.001"
    want = {}
    for i, text in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect():
        words = (text or "").encode().split()
        words = [w.decode() for w in words]
        h, n = zlib.crc32(str(i).encode()), len(words)
        g = h // 10
        if n > 4000:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = plain(words)
        top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want[i] = (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, dropped(words, runs))))
    got = {r[0]: tuple(r)[1:] for r in op13_periodic_runs(spark, path).collect()}
    assert sum(r[0] > 0 for r in want.values()) > 10
    assert {i: got[i] for i in want} == want
