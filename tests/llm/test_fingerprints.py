"""Winnowing against brute force: prints, the guarantee, successors over partitions, odd rows."""

import hashlib
import random

import numpy as np
import pytest

from ledgerlens.llm.winnowing import fingerprints, guarantee, likeness, prints, rolling_hashes, successor_fingerprints, tail_swapped


def plain(text, gram, window):
    """(hash, position) of the prints, window by window."""
    if not text:
        return []
    one = lambda s: int(rolling_hashes(np.frombuffer(s.encode("utf-32-le"), np.uint32), np.array([0]), np.array([len(s)]))[0])
    grams = [one(text[i : i + gram]) for i in range(max(1, len(text) - gram + 1))]
    found = []
    for i in range(max(1, len(grams) - window + 1)):
        part = grams[i : i + window]
        low = min(part)
        at = i + max(j for j, h in enumerate(part) if h == low)
        if not found or found[-1] != (low, at):
            found.append((low, at))
    return found


@pytest.mark.parametrize("gram, window", [(5, 4), (20, 31), (3, 1), (1, 8)])
def test_prints_match_brute_force(gram, window):
    rng = random.Random(gram)
    texts = ["", "a", "ab", "é" * 60, "ab" * 80] + ["".join(rng.choice("abé☃𝄞") for _ in range(rng.randint(0, 200))) for _ in range(60)]
    hashes, places, bounds = prints(texts, gram, window)
    for i, t in enumerate(texts):
        got = list(zip(hashes[bounds[i] : bounds[i + 1]].tolist(), places[bounds[i] : bounds[i + 1]].tolist()))
        assert got == plain(t, gram, window)


def test_shared_passage_shares_a_print():
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        passage = some(guarantee())
        one, other = some(rng.randint(0, 90)) + passage + some(rng.randint(0, 90)), some(rng.randint(0, 90)) + passage + some(5)
        hashes, places, bounds = prints([one, other])
        where = [dict(zip(hashes[a:b].tolist(), places[a:b].tolist())) for a, b in zip(bounds, bounds[1:])]
        shared = set(where[0]) & set(where[1])
        assert any(one[where[0][h] : where[0][h] + 20] == other[where[1][h] : where[1][h] + 20] for h in shared)


def expected(rows):
    """Results of successor_fingerprints by sorted rows, for distinct keys."""
    out = {}
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = tail_swapped(text, after)
        sets = [np.array([h for h, _ in plain(t, 20, 31)], dtype=np.int64) for t in (text, edited, after)]
        code = lambda s: "".join(f"{h:08x}" for h in s.tolist())
        out[key] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), code(sets[0]), code(sets[1]), likeness(sets[0], sets[1]), likeness(sets[0], sets[2]))
    return out


FIELDS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_successors_match_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 400))) for _ in range(30)]
    rows = [(rng.randint(0, 1 << 50) * 2 + k % 2, rng.choice(base)) for k in range(90)] + [(None, base[0]), (-5, None), (3, ""), (1 << 60, "x"), ((1 << 60) + 1, "y" * 5000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, slot string, id int").repartition(5)
    got = {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in successor_fingerprints(docs).collect()}
    assert got == expected(rows)


def test_repeated_and_missing_rows(spark):
    docs = spark.createDataFrame([(1, "a" * 40)] * 3 + [(2, "b" * 40), (2, "c" * 40)], "doc_id long, text string")
    got = successor_fingerprints(docs).collect()
    assert len(got) == 5 and sum(r["near_next"] == 1.0 for r in got if r["doc_id"] == 1) == 2
    assert successor_fingerprints(docs.limit(0)).collect() == []
    alone = successor_fingerprints(docs.where("doc_id = 1").limit(1)).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"a" * 40).hexdigest() and alone["near_next"] == alone["near_edited"] == 1.0


def test_fingerprints(spark):
    rows = [(1, "abc " * 100), (2, None), (None, "short")]
    got = {r["doc_id"]: list(zip(r["hashes"], r["positions"])) for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: plain(t or "", 20, 31) for i, t in rows}


def test_query(spark):
    from ledgerlens.llm.q_fingerprints import op11_fingerprints

    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").where("length(text) < 3000").collect()]
    want = expected([tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]) if len(rows) < 400 else {}
    got = {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in op11_fingerprints(spark, path).collect()}
    assert got == want
