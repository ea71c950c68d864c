"""HyperMinHash near-duplicates against brute force."""

import re

import numpy as np
import pytest

from ledgerlens.llm import hyperminhash as H
from ledgerlens.llm.common import Words
from pyspark.sql import types as T

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.StringType())]
)


def plain_set(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = BLANK.findall(lower)
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def plain_components(rows, percent):
    """{(id, text): component} by comparing every pair of rows that share a shingle."""
    sets = [(i, plain_set(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            held.setdefault(x, []).append(k)
    seen = {(a, b) for ks in held.values() for n, a in enumerate(ks) for b in ks[n + 1 :]}
    for a, b in seen:
        x, y = sets[a][1], sets[b][1]
        if 100 * len(x & y) >= percent * len(x | y):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k][1]), least[find(k)]) for k, (i, _) in enumerate(rows)]


def test_word_hashes_follow_the_words():
    words = Words([b"ab c\x0bab", b"", b" c ", b"x" * 50])
    assert list(np.diff(words.bounds)) == [3, 0, 1, 1]
    h = words.hashes
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(5)
    off = []
    for size, shared in ((8, 7), (60, 50), (3000, 2600)):
        for _ in range(20):
            pool = rng.integers(0, 2**63, 2 * size - shared, dtype=np.uint64)
            a, b = np.unique(pool[:size]), np.unique(pool[size - shared :])
            got = H.estimate_pairs(H.sketch(a, 200)[None], H.sketch(b, 200)[None], np.array([size]), np.array([size]))[0]
            off.append(got - shared / (2 * size - shared))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.05


def texts():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows, doc = [], 0
    for _ in range(12):
        base = [word() for _ in range(int(rng.integers(6, 200)))]
        for _ in range(int(rng.integers(1, 14))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 40))):
                copy[int(rng.integers(0, len(copy)))] = word()
            rows.append((doc, " ".join(copy)))
            doc += 1
    rows += [(doc + 1, ""), (doc + 2, " \n "), (doc + 3, "One TWO"), (doc + 4, "one\ttwo"), (doc + 5, "x" * 5000)]
    rows += [(doc + 6, "w " * 40_000), (doc + 7, "É é b c d"), (doc + 8, "É É b c d"), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("block", [512, 4])
def test_components_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(H, "BLOCK", block)
    rows = texts()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    got = sorted((r[0], r[1], r[2]) for r in H.near_duplicates(docs).collect())
    assert got == sorted(plain_components(rows, 85))


def test_nulls_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c", None), (2, None, None), (2, "a b c", None), (9, "a b c", None)], SCHEMA)
    got = {(r[0], r[1], r[2], r[3]) for r in H.near_duplicates(docs).collect()}
    assert got == {(None, 1, None, True), (2, 0, 2, True), (2, 1, 2, True), (9, 1, 2, False)}
    assert H.near_duplicates(docs.limit(0)).collect() == []


def test_query_matches_brute_force_on_the_tables(spark):
    from ledgerlens.llm.q_near import op2_minhash_near_dedup

    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r[0], r[1], r[2]) for r in op2_minhash_near_dedup(spark, path).collect())
    assert got == sorted(plain_components(rows, 85))
