"""The rule of an overlap, stated over all stretches: enough equal words, at most one in four changed."""

import numpy as np

from ledgerlens.llm.spaced_seeds import MASKS, SPAN, contaminated


def passes(item, doc, least=10):
    """Copies of equal length, laid on each other."""
    equal = [a == b for a, b in zip(item, doc)]
    n = len(equal)
    hit = any(all(equal[k + j] for j in range(SPAN) if m[j] == "1") for m in MASKS for k in range(n - SPAN + 1))
    stretches = (equal[i:j] for i in range(n) for j in range(i + 1, n + 1))
    return hit, any(sum(e) >= least and 4 * (len(e) - sum(e)) <= len(e) for e in stretches)


def pairs(spark, cases):
    docs = spark.createDataFrame([(k, " ".join(d)) for k, (_, d) in enumerate(cases)], "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(i)) for k, (i, _) in enumerate(cases)], "item_id long, text string")
    return contaminated(docs, items).collect()


def copy(case, n, changed):
    item = [f"c{case}w{k}" for k in range(n)]
    return item, [f"c{case}x{k}" if k in changed else w for k, w in enumerate(item)]


def test_changed_words_inside_a_copy(spark):
    changes = [(19, (8, 9, 10)), (20, (3, 7, 11, 15, 19)), (12, (2,)), (12, (8,)), (12, (2, 8)), (16, (1, 4, 11))]
    cases = [copy(k, n, changed) for k, (n, changed) in enumerate(changes)]
    want = {(k, k) for k, c in enumerate(cases) if all(passes(*c))}
    assert {(0, 0), (2, 2), (3, 3)} <= want
    got = pairs(spark, cases)
    assert {tuple(r)[:2] for r in got} == want
    assert tuple(got[[r[0] for r in got].index(0)])[2:] == (16, 19, 19, 0)


def test_random_substitutions_follow_the_rule(spark):
    rng = np.random.default_rng(4)
    sizes = [(16, 3), (16, 4), (20, 4), (20, 5), (20, 7), (12, 2), (40, 12)] * 30
    cases = [copy(k, n, set(rng.choice(n, c, replace=False).tolist())) for k, (n, c) in enumerate(sizes)]
    verdicts = [all(passes(*c)) for c in cases]
    assert 100 < sum(verdicts) < len(cases)
    got = pairs(spark, cases)
    assert {tuple(r)[:2] for r in got} == {(k, k) for k, v in enumerate(verdicts) if v}
    assert all(r["n_equal"] >= 10 and 4 * (r["n_words"] - r["n_equal"]) <= r["n_words"] for r in got)


def stretches(item, doc, least=10):
    """The best stretch of each diagonal where a mask fits: all stretches tried."""
    for offset in range(-len(item) + 1, len(doc)):
        low, high = max(0, -offset), min(len(item), len(doc) - offset)
        e = [item[k] == doc[k + offset] for k in range(low, high)]
        n = len(e)
        if any(all(e[k + j] for j in range(SPAN) if m[j] == "1") for m in MASKS for k in range(n - SPAN + 1)):
            runs = ((sum(e[i:j]), j - i, low + offset + i) for i in range(n) for j in range(i + 1, n + 1))
            runs = [r for r in runs if r[0] >= least and 4 * (r[1] - r[0]) <= r[1]]
            if runs:
                yield max(runs, key=lambda r: (r[0] - 3 * (r[1] - r[0]), -r[2], -r[1]))


def test_all_diagonals_of_longer_documents(spark):
    rng = np.random.default_rng(9)
    vocabulary = ["".join(rng.choice(list("abcdef"), 4)) for _ in range(40)]
    some = lambda n: [str(x) for x in rng.choice(vocabulary, n)]
    items = [some(n) for n in (11, 14, 25, 40)]
    docs = []
    for k in range(60):
        body, piece = some(int(rng.integers(0, 50))), list(items[k % 4])
        for at in rng.choice(len(piece), int(rng.integers(0, len(piece) // 3)), replace=False):
            piece[at] = "changed"
        cut = int(rng.integers(0, len(body) + 1))
        docs.append(body[:cut] + piece[: len(piece) if k % 2 else len(piece) * 3 // 4] + body[cut:])
    want = set()
    for i, d in enumerate(docs):
        for j, w in enumerate(items):
            found = sorted(stretches(w, d), key=lambda r: (-r[0], r[1], r[2]))
            if found:
                want.add((i, j, *found[0][:2], len(w), found[0][2]))
    assert len(want) > 15
    frame = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    assert {tuple(r) for r in contaminated(frame, bench).collect()} == want
