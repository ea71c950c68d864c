"""Top-k search and chat rotation against plain versions, odd rows, and the SQL."""

import math

import numpy as np
import pytest

from ledgerlens.llm import chat_rotation, topk_search
from ledgerlens.llm.chat_rotation import rotate
from ledgerlens.llm.topk_search import top_k
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, score string"


def plain_top(rows, k, every):
    fine = {
        (i, tuple(math.floor(64 * x) for x in v))
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    first = {}
    for i, v in sorted(fine):
        if i % every == 0:
            first.setdefault(i, v)
    out = set()
    for q, v in first.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(w) == len(v))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("sizes", [(8192, 4096), (16, 3)])
def test_top_k_matches_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(topk_search, "CANDIDATES", sizes[0])
    monkeypatch.setattr(topk_search, "QUERIES", sizes[1])
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.1, 40)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(30)] + [(5, rows[9][1]), rows[5], rows[10], (20, rows[3][1])]
    rows += [(400, None), (401, []), (420, []), (402, [None] * 40), (None, rows[1][1]), (403, [float("nan")] * 40), (404, [float("inf")] * 40)]
    rows += [(440, [1.0, 2.0]), (441, [-1.0, 1e6]), (460, [1e7, 1e7])]
    frame = spark.createDataFrame([(i, v, "clash") for i, v in rows], VECTORS)
    got = {tuple(r) for r in top_k(frame, F.col("vec_id") % 20 == 0, k=7).collect()}
    # Of two query vectors under one id the one first in array order asks.
    assert got == plain_top(rows, 7, 20)
    assert top_k(frame.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def plain_chat(rows):
    out = {}
    for conv in {r[0] for r in rows if r[0] is not None}:
        mine = [(t, r if r is not None else "unknown", x or "") for c, t, r, x in rows if c == conv]
        for who in {r for _, r, _ in mine} - {"system"}:
            for part in {None if t is None else t // chat_rotation.PART_TURNS for t, _, _ in mine}:
                turns = sorted((t for t in mine if (None if t[0] is None else t[0] // chat_rotation.PART_TURNS) == part), key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
                text, mask = "", []
                for _, role, said in turns:
                    name = "assistant" if role == who else role if role == "system" else "user name=" + role.replace("<|", "<\\|")
                    text += f"<|im_start|>{name}\n"
                    start = len(text)
                    text += said.replace("<|", "<\\|") + "<|im_end|>\n"
                    if role == who:
                        mask.append((start, len(text)))
                out[conv, who, part] = (len(turns), text, mask)
    return out


def test_rotation_matches_plain(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "é\n中"), (1, 3, "ann", None)]
    rows += [(2, 5, None, "x"), (2, None, "bob", "first"), (2, 5, None, "x"), (2, 5, "bob", "tie"), (None, 1, "ann", "lost")]
    rows += [(3, 0, "system", "alone"), (4, 0, "a<|b", ""), (5, 255, "ann", "x" * 200_000), (5, 256, "bob", "next part"), (6, -1, "ann", "y")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {(r["conv_id"], r["perspective"], r["part"]): (r["n_turns"], r["rendered"], [tuple(m) for m in r["mask"]]) for r in rotate(frame).collect()}
    assert got == plain_chat(rows)
    for (_, _, _), (_, text, mask) in got.items():
        assert all(text[:a].endswith("assistant\n") and text[a:b].endswith("<|im_end|>\n") for a, b in mask)
    assert rotate(frame.limit(0)).collect() == []
