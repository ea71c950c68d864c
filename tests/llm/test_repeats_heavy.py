"""A phrase with very many different surroundings against brute force, in tasks of bounded size."""

import random

from ledgerlens.llm import repeated_strings as R
from ledgerlens.llm.repeated_strings import drop_repeats
from tests.llm.test_repeats import found, plain


def test_frequent_phrase_in_bounded_tasks(spark, monkeypatch):
    bound, ranges = 4000, R._ranges

    def checked(runs, length):
        assert runs["piece"].map(len).sum() <= 2 * bound
        return ranges(runs, length)

    monkeypatch.setattr(R, "SHARD", bound)
    monkeypatch.setattr(R, "_ranges", checked)
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    phrase, shared = "Posted by the editors of the daily page", [noise(60) for _ in range(4)]
    rows = []
    for i in range(400):
        left = noise(40) if i % 3 else rng.choice(shared)
        right = noise(40) if i % 4 else rng.choice(shared)
        rows.append((i, left + phrase + right + phrase + noise(9)))
    rows += [(3, noise(30) + phrase + shared[0]), (None, rows[0][1]), (500, rows[7][1])]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain(rows, 50)
    assert sum(r[3] > 0 for r in want) > 100
    assert found(drop_repeats(docs)) == want
