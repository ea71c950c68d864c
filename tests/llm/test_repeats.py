"""Removal of repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from ledgerlens.llm import repeated_strings as R
from ledgerlens.llm.repeated_strings import drop_repeats, suffix_names


def plain(rows, length):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, d in data:
        if i is not None:
            for k in range(len(d) - length + 1):
                s = d[k : k + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, d in data:
        gone = [False] * len(d)
        for k in range(len(d) - length + 1) if i is not None else ():
            if first[d[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((i is not None, i or 0, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted(
        (r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest())
        for r in df.collect()
    )


def test_suffix_names_are_sorted_prefixes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    for length in (24, 32, 50, 64):
        valid = np.arange(len(data) - length + 1)
        names = suffix_names(data, valid, length)
        strings = [data[k : k + length].tobytes() for k in valid]
        order = {s: n for n, s in enumerate(sorted(set(strings)))}
        assert names.tolist() == [order[s] for s in strings]


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 21), (100, 300)])
def test_matches_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(R, "SEGMENT", sizes[0])
    monkeypatch.setattr(R, "SHARD", sizes[1])
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    pool = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(12)]
    rows = []
    for i in range(80):
        parts = [rng.choice(pool)[rng.randint(0, 20) :] if rng.random() < 0.6 else " ".join(word() for _ in range(20)) for _ in range(rng.randint(0, 6))]
        rows.append((i, "|".join(parts)))
    rows += [(100, None), (101, ""), (102, "x" * 49), (103, "x" * 300), (104, "x" * 120), (None, pool[0] * 3), (-1, pool[1]), (7, pool[2] + pool[3]), (7, pool[2] + pool[3]), (105, "ab" * 400)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, spans string, sign int").repartition(4)
    assert found(drop_repeats(docs)) == plain(rows, 50)
    assert drop_repeats(docs.limit(0)).collect() == []


def test_query(spark):
    from ledgerlens.llm.q_repeats import op9_suffix_dedup

    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((True, r[0], r[1], r[2], r[3], r[4]) for r in op9_suffix_dedup(spark, path).collect())
    assert got == plain(rows, 50)


def test_little_goes_between_blocks(spark, monkeypatch):
    """Copies within a block are one, texts are not dealt again: far less is shuffled and written than runs have bytes."""
    kept = []
    monkeypatch.setattr(R, "checkpointed", lambda df, made=R.checkpointed: kept.append(made(df)) or kept[-1])
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    page = " ".join(word() for _ in range(3000))
    rows = [(i, page[i:] + str(i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert found(drop_repeats(docs)) == plain(rows, 50)
    size = sum(len(t) for _, t in rows)
    written = sum(len(b["data"]) for df in kept for b in df.select("data").collect())
    assert len(kept) == 1 and written < size / 4


def test_equal_signs_of_other_bytes(spark, monkeypatch):
    """Strings with one hash but other bytes stay apart."""
    text = np.frombuffer(b"abcabdabcabcabx", np.uint8)
    begin, size = np.array([0, 3, 6, 9, 12]), np.full(5, 3)
    same = R.Distinct(text, begin, size, np.zeros(5, np.uint64))
    assert [same.group[0] == g for g in same.group] == [True, False, True, True, False]
    assert len(same.head) == 3 and same.group[1] != same.group[4]


@pytest.mark.parametrize("kind", ["string", "int", "date"])
def test_ids_of_other_types_in_several_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(R, "BLOCK", 500)
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdé ") for _ in range(90)) for _ in range(9)]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 4)))) for i in range(1, 90)]
    rows += [(5, pool[0] * 2), (5, pool[0] * 2), (None, pool[1]), (95, None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    number = "date_add(date'2020-01-01', cast(doc_id as int))" if kind == "date" else "lpad(doc_id, 3, '0')" if kind == "string" else "doc_id"
    back = "datediff(doc_id, date'2020-01-01')" if kind == "date" else "doc_id"
    got = drop_repeats(docs.selectExpr(f"cast({number} as {kind}) doc_id", "text"))
    assert got.schema["doc_id"].dataType.simpleString() == kind
    assert found(got.selectExpr(f"cast({back} as long) doc_id", "n_bytes", "n_removed", "n_spans", "kept")) == plain(rows, 50)
