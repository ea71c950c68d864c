"""Spaced seeds against a plain comparison of every document with every item."""

import re

import numpy as np

from ledgerlens.llm.spaced_seeds import MASKS, SHORTEST, SPAN, contaminated

WORD = re.compile(r"[^\s!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+")


def words(text):
    return WORD.findall((text or "").lower())


def plain(docs, items, least=10):
    out = set()
    for doc_id, text in docs:
        d = words(text)
        for item_id, passage in items:
            w = words(passage)
            best = (0, 0, 0)
            if len(w) < SHORTEST:
                continue
            for offset in range(-len(w) + 1, len(d)):
                eq = [0 <= k + offset < len(d) and d[k + offset] == w[k] for k in range(len(w))]
                inside = [0 <= k + offset < len(d) for k in range(len(w))]
                if len(w) < SPAN:
                    seeded = all(eq)
                else:
                    seeded = any(
                        all(inside[k : k + SPAN]) and all(eq[k + j] for j in range(SPAN) if m[j] == "1")
                        for m in MASKS
                        for k in range(len(w) - SPAN + 1)
                    )
                if not seeded:
                    continue
                # Any stretch with enough equal words and at most one in four changed counts; short items match in full.
                ks = [k for k in range(len(w)) if inside[k]]
                enough = least if len(w) >= SPAN else len(w)
                top = None
                for i in range(len(ks)):
                    equal = 0
                    for j in range(i, len(ks)):
                        equal += eq[ks[j]]
                        length = j - i + 1
                        if equal >= enough and 4 * (length - equal) <= length:
                            found = (equal - 3 * (length - equal), -(ks[i] + offset), -length, equal)
                            top = max(top or found, found)
                if top:
                    found = (top[3], -top[2], -top[1])
                    if (found[0], -found[1], -found[2]) > (best[0], -best[1], -best[2]):
                        best = found
            if best[0]:
                out.add((doc_id, item_id, *best[:2], len(w), best[2]))
    return out


def test_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    vocabulary = ["".join(rng.choice(list("abcdef"), 4)) for _ in range(40)]
    some = lambda n: [str(x) for x in rng.choice(vocabulary, n)]
    items = [(k, some(int(n))) for k, n in enumerate((4, 5, 9, 10, 11, 14, 25, 40))] + [(99, [])]
    docs = []
    for k in range(120):
        body = some(int(rng.integers(0, 60)))
        piece = list(items[k % 8][1])
        for _ in range(int(rng.integers(0, 4)) * len(piece) // 12):
            piece[int(rng.integers(0, len(piece)))] = "changed"
        if k % 3:
            cut = int(rng.integers(0, len(body) + 1))
            body[cut:cut] = piece[: len(piece) if k % 2 else len(piece) // 2 + 3]
        docs.append((k, ", ".join(body).upper() if k % 5 == 0 else " ".join(body)))
    items = [(k, " ".join(w)) for k, w in items]
    want = plain(docs, items)
    assert len(want) > 15
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, words string, item long")
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    assert {tuple(r) for r in contaminated(frame, bench).collect()} == want


def test_nulls_empty_and_long(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, passage), (2, None), (None, "five words are in here")], "item_id long, text string")
    rows = [(1, None), (2, ""), (None, passage), (4, "y " * 100_000 + passage), (4, "y " * 100_000 + passage), (5, "FIVE words; are in here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r)[:2] for r in contaminated(docs, bench).collect()}
    assert got == {(None, 1), (4, 1), (5, None)}
    assert contaminated(docs.limit(0), bench).collect() == []
    assert contaminated(docs, bench.limit(0)).collect() == []


def test_query_finds_all_whole_passages(spark):
    from ledgerlens.llm.q_decontamination import op6_benchmark_decontamination

    path = "/root/testdata/sf0.01"
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{path}/{t}.parquet").select(*c).collect()]
    docs, items = read("documents", "doc_id", "text"), read("benchmark", "item_id", "text")
    whole = {(i, j) for i, t in docs for j, p in items if p in t}
    got = {tuple(r)[:2] for r in op6_benchmark_decontamination(spark, path).collect()}
    assert whole and whole <= got
    assert {i for i, _ in got} == {i for i, _ in whole}
