"""Benchmark decontamination with spaced seeds.

A seed is a hash of the words of a window at the positions that a fixed mask keeps; the masks ignore some
positions, so that a changed word there leaves the seed as it is. Seeds of the benchmark are a table. A bit
filter over them, of a size set by their number and bounded, goes to the tasks; one pass over the texts
keeps the windows that it lets through, and the word hashes of the documents that have any. The windows
are joined to the seeds by hash; each (document, item, offset) found is then verified word by word along
its diagonal, in both directions from the hit.

The filter only saves work: a full one lets every window through and the join decides. A passage that a
third of all documents hold gives many rows of one seed; the join has exchanges on both sides, so AQE
splits it, and diagonals are combined on the map side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import GOLDEN, Words, byte_chunks, checkpointed, mix
from ledgerlens.llm.toxicity import SEPARATORS

#: Fixed masks over 11 words; 1 keeps a position.
MASKS = ("11100100101", "11010010011", "10110001101", "11001101001", "10101011010", "01110110001")
SPAN = len(MASKS[0])
SHORTEST = 5  # words of an item that is matched at all
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
MISMATCH = 3  # a changed word costs as much as so many equal ones gain


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text: lower case, blanks and ASCII punctuation separate words."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    for part in byte_chunks([len(t) for t in raw]):
        words = Words(raw[part], SEPARATORS)
        for start, stop in zip(words.bounds[:-1], words.bounds[1:]):
            yield words.hashes[start:stop]


def _shapes(lengths: tuple[int, ...]) -> list[tuple[int, list[int], int]]:
    """(span, kept positions, salt): the masks, and all words of each item length below the span."""
    masks = [(SPAN, [i for i, c in enumerate(m) if c == "1"], 100 + k) for k, m in enumerate(MASKS)]
    return masks + [(n, list(range(n)), 200 + n) for n in lengths]


def _windows(words: np.ndarray, span: int, picked: list[int], salt: int) -> np.ndarray:
    view = Words.__new__(Words)
    view.hashes = words
    return view.windows(span, picked, salt)


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two filter positions of each hash."""
    low = np.uint64(bits - 1)
    return hashes & low, mix(hashes + GOLDEN) & low


def best_segment(doc: np.ndarray, item: np.ndarray, offset: int, least: int) -> tuple[int, int, int]:
    """(equal words, words, first word in doc) of the best run of ``item`` laid on ``doc`` at ``offset``.

    Of all runs with ``least`` equal words or more and at most one word in four changed, that is those whose
    sum of +1 for an equal and -MISMATCH for a changed word is not negative, the one with the largest sum; the
    earliest of those, and the shortest from there. Zeros if there is none.
    """
    low, high = max(0, -offset), min(len(item), len(doc) - offset)
    equal = item[low:high] == doc[low + offset : high + offset]
    n_equal = np.concatenate([[0], np.cumsum(equal)])
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISMATCH))])
    # The last start that leaves ``least`` equal words before each end.
    latest = np.searchsorted(n_equal, n_equal - least, side="right") - 1
    before = np.minimum.accumulate(total)[latest]
    gain = np.where(latest >= 0, total - before, -1)
    end = int(np.argmax(gain))
    if gain[end] < 0:
        return 0, 0, 0
    start = int(np.flatnonzero(total[: latest[end] + 1] == before[end])[0])
    return int(n_equal[end] - n_equal[start]), end - start, low + offset + start


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    min_words: int = 10,
) -> DataFrame:
    """One row for each document and benchmark item that share a passage.

    (``doc_id``, ``item_id``, ``n_equal``, ``n_words``, ``item_words``, ``doc_start``): words that are equal
    within the best overlap, its length in words, the item's length, and the overlap's first word in the
    document (from 0). Any stretch counts as an overlap that has ``min_words`` equal words or more (all words
    of an item with fewer than 11), at most one word in four changed, and, on the same diagonal, a window of 11
    words where a mask fits.
    Items with fewer than 5 words prove nothing and match nothing.

    Null and empty texts match nothing. Rows with a null id are reported with that null id. Repeated rows
    of either table give one row; rows with one id and different texts are compared each. Of several equally
    good overlaps the first in the document is told. Empty tables give an empty table.
    """
    return overlaps(docs, benchmark, id_col, text_col, item_col, item_text_col, min_words=min_words).drop("sign")


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    min_words: int = 10,
) -> DataFrame:
    """The rows of ``contaminated`` with ``sign``, the xxhash64 of the document's text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    items = items.where(F.col("text").isNotNull()).distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "text"))

    def item_words(batches):
        for batch in batches:
            found = list(word_hashes(batch["text"].tolist()))
            yield pd.DataFrame(
                {
                    "item": batch["item"],
                    "item_id": batch["item_id"],
                    "m": [len(w) for w in found],
                    "item_hashes": [w.tobytes() for w in found],
                }
            )

    id_kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    hashed = checkpointed(
        items.mapInPandas(item_words, f"item bigint, item_id {item_kind}, m int, item_hashes binary").where(
            F.col("m") >= SHORTEST
        )
    )
    short = hashed.where(F.col("m") < SPAN).select("m").distinct().collect()  # at most six numbers
    shapes = _shapes(tuple(sorted(r[0] for r in short)))

    def item_seeds(batches):
        for batch in batches:
            for item, data in zip(batch["item"], batch["item_hashes"]):
                words = np.frombuffer(data, np.uint64)
                for span, picked, salt in shapes:
                    if span == SPAN or span == len(words):
                        found = _windows(words, span, picked, salt)
                        yield pd.DataFrame(
                            {"seed": found.view(np.int64), "item": item, "at": np.arange(len(found), dtype=np.int32)}
                        )

    seeds = checkpointed(
        hashed.mapInPandas(item_seeds, "seed bigint, item bigint, at int").distinct()
    )
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < 64 * seeds.select("seed").count():
        bits *= 2

    def seed_slots(batches):
        for batch in batches:
            both = np.concatenate(_slots(batch["seed"].to_numpy().view(np.uint64), bits))
            yield pd.DataFrame({"byte": (both >> np.uint64(3)).astype(np.int64), "bit": 1 << (both & np.uint64(7)).astype(np.int32)})

    # At most bits / 8 rows, whatever the number of seeds.
    marked = (
        seeds.mapInPandas(seed_slots, "byte bigint, bit int").groupBy("byte").agg(F.bit_or("bit").alias("bit")).toPandas()
    )
    table = np.zeros(bits // 8, np.uint8)
    table[marked["byte"]] = marked["bit"]
    shipped = spark.sparkContext.broadcast(table)

    def scan(batches):
        filled = shipped.value
        for batch in batches:
            rows = []
            for key, sign, words in zip(batch["id"], batch["sign"], word_hashes(batch["text"].tolist())):
                at, seed = [], []
                for span, picked, salt in shapes:
                    found = _windows(words, span, picked, salt)
                    hit = np.ones(len(found), bool)
                    for slot in _slots(found, bits):
                        hit &= (filled[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    places = np.flatnonzero(hit)
                    at.append(places)
                    seed.append(found[places].view(np.int64))
                at = np.concatenate(at)
                if len(at):
                    rows.append((key, sign, at.astype(np.int32), np.concatenate(seed), words.tobytes()))
            yield pd.DataFrame(rows, columns=["id", "sign", "at", "seeds", "words"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    source = source.where(F.col("text").isNotNull()).withColumn("sign", F.xxhash64("text"))
    hits = checkpointed(
        source.mapInPandas(scan, f"id {id_kind}, sign bigint, at array<int>, seeds array<bigint>, words binary")
    )
    pairs = hits.select("id", "sign", F.explode(F.arrays_zip("at", "seeds")).alias("h")).select(
        "id", "sign", F.col("h.at").alias("_at"), F.col("h.seeds").alias("_seed")
    )
    offsets = checkpointed(
        pairs.join(seeds, F.col("_seed") == F.col("seed"))
        .select("id", "sign", "item", (F.col("_at") - F.col("at")).alias("offset"))
        .distinct()
        .groupBy(F.col("id").alias("_id"), F.col("sign").alias("_sign"), "item")
        .agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    )

    def verify(batches):
        for batch in batches:
            rows = []
            for key, sign, item_id, m, item, words, places in zip(
                batch["id"], batch["sign"], batch["item_id"], batch["m"], batch["item_hashes"], batch["words"], batch["offsets"]
            ):
                item, words = np.frombuffer(item, np.uint64), np.frombuffer(words, np.uint64)
                best = (0, 0, 0)
                for offset in places:
                    found = best_segment(words, item, int(offset), min_words if m >= SPAN else m)
                    if (found[0], -found[1], -found[2]) > (best[0], -best[1], -best[2]):
                        best = found
                equal, length, start = best
                if equal:
                    rows.append((key, sign, item_id, equal, length, m, start))
            yield pd.DataFrame(rows, columns=["id", "sign", "item_id", "n_equal", "n_words", "item_words", "doc_start"])

    known = hits.select("id", "sign", "words").dropDuplicates(["id", "sign"])
    names = hashed.withColumnRenamed("item", "_item")
    return (
        known.join(offsets, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sign") == F.col("_sign")))
        .join(names, F.col("item") == F.col("_item"))
        .select("id", "sign", "item_id", "m", "item_hashes", "words", "offsets")
        .mapInPandas(
            verify,
            f"id {id_kind}, sign bigint, item_id {item_kind}, n_equal int, n_words int, item_words int, doc_start int",
        )
        .withColumnRenamed("id", id_col)
        .withColumnRenamed("item_id", item_col)
    )
