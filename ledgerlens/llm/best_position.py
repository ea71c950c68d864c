"""Ranked lexical search with the Best Position Algorithm.

Documents are dealt out as they are read. A task holds a bounded shard of them at a time, with one impact list per query
term: the shard's documents by descending impact. For each query the lists are read in parallel from the top.
Every document met is looked up in all lists of the query (direct access), which marks its positions there as seen. A
list's best position ends its unbroken stretch of seen positions, and the impacts at the best positions add up to the
most that an unseen document can score. A shard is left when that is strictly below the k-th score so far, which the
task carries from shard to shard. A task returns at most k documents per query; a window over these gives the ranks.

The texts are never shuffled. Queries are read in blocks of at most ``BLOCK`` terms, each with two passes over the documents:
one for the counts, one for the search.

Terms are known by 64-bit hashes. Defined results: a null or empty text has no terms, scores nothing and counts for
nothing; rows that repeat are ranked as so many documents, in any order among themselves; rows of the query table that
repeat count once, and two texts under one id are two queries. A document without an id comes last among equal scores.
Only the columns named are read. An empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerlens.llm.common import Words, byte_chunks, checkpointed

#: Bytes that end a term: all of ASCII but letters and digits.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
BLOCK = 1 << 16  # query terms, with repeats, handled at once
SHARD_BYTES, SHARD_CELLS = 1 << 23, 1 << 25  # of text, and of the table of positions by term and document
NO_ID = (1 << 63) - 1
FIRST_DEPTH = 8


def terms_of(texts: Sequence[bytes]) -> Words:
    return Words([t.lower() for t in texts], SEPARATORS)  # bytes.lower changes A-Z alone


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


@dataclass
class Queries:
    """Term hashes in ascending order and, per query, the terms it has (as indices) and how often."""

    hashes: np.ndarray
    terms: list[np.ndarray]
    times: list[np.ndarray]

    @classmethod
    def of(cls, texts: Sequence[str | None]) -> Queries:
        words = terms_of([(t or "").encode() for t in texts])
        hashes, slot = np.unique(words.hashes, return_inverse=True)
        each = [np.unique(slot[a:b], return_counts=True) for a, b in zip(words.bounds, words.bounds[1:])]
        return cls(hashes, [t for t, _ in each], [n for _, n in each])

    def held(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text its number of terms; and per distinct (term of the queries, text) both and the occurrences."""
        words = terms_of(texts)
        sizes = np.diff(words.bounds)
        empty = np.zeros(0, np.int64)
        if not len(self.hashes):
            return sizes, empty, empty, empty
        slot = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[slot] == words.hashes)
        text = np.searchsorted(words.bounds, hit, side="right") - 1
        keys, times = np.unique(slot[hit] * len(texts) + text, return_counts=True)
        return sizes, keys // len(texts), keys % len(texts), times


class Shard:
    """Impact lists of some documents, and the position of each document in each list."""

    def __init__(self, n_terms: int, ids: np.ndarray, slot: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        fine = impact > 0
        slot, doc, impact = slot[fine], doc[fine], impact[fine]
        order = np.lexsort((doc, -impact, slot))
        slot, self.doc, self.impact, self.ids = slot[order], doc[order], impact[order], ids
        self.start = np.searchsorted(slot, np.arange(n_terms + 1))
        self.position = np.full((n_terms, len(ids)), -1, np.int32)
        self.position[slot, self.doc] = np.arange(len(slot)) - self.start[slot]

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` of the documents given (``scores`` and ``ids``, best first) and this shard's."""
        begin = self.start[terms]
        size = self.start[terms + 1] - begin
        some = size > 0
        terms, times, begin, size = terms[some], times[some], begin[some], size[some]
        if not len(terms):
            return scores, ids
        shift = np.concatenate([[0], np.cumsum(size)])
        unseen = np.ones(shift[-1], bool)  # positions of all lists, one list after another
        known = np.zeros(len(self.ids), bool)
        low, depth = 0, FIRST_DEPTH
        while True:
            # Sorted access: positions low to depth of every list that has them.
            span = np.clip(size - low, 0, depth - low)
            at = np.repeat(begin + low - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
            docs = np.unique(self.doc[at])
            docs = docs[~known[docs]]
            known[docs] = True
            # Direct access: the documents' positions in all lists of the query.
            position = self.position[np.ix_(terms, docs)]
            row, column = np.nonzero(position >= 0)
            position = position[row, column]
            unseen[shift[row] + position] = False
            gained = times[row] * self.impact[begin[row] + position]
            totals = np.zeros(len(docs), np.int64)
            np.add.at(totals, column, gained)
            scores, ids = best(np.concatenate([scores, totals]), np.concatenate([ids, self.ids[docs]]), k)
            # Best positions: the first unseen position of a list bounds its unseen documents.
            gaps = np.flatnonzero(unseen)
            first = np.searchsorted(gaps, shift[:-1])
            left = np.append(gaps, shift[-1])[first]
            open_ = left < shift[1:]
            # The impact at the best position, which the first unseen position does not exceed.
            reach = begin[open_] + left[open_] - shift[:-1][open_] - 1
            most = int((times[open_] * self.impact[np.maximum(reach, begin[open_])]).sum())
            if not open_.any() or (len(scores) == k and most < scores[-1]):
                return scores, ids
            low, depth = depth, 2 * depth


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > k:
        fine = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[fine], ids[fine]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def impacts(weights: np.ndarray, slot: np.ndarray, doc: np.ndarray, times: np.ndarray, sizes: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What each (term, document) adds to a score; whole numbers, divisions round down."""
    damp = 25 + (75 * sizes.astype(np.int64) * documents) // max(total, 1)
    return weights[slot] * ((1_000_000_000 * times) // (1000 * times + 8 * damp[doc]))


def _counts(docs: DataFrame, queries: Queries) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents that hold each query term."""
    shared = docs.sparkSession.sparkContext.broadcast(queries.hashes)  # at most BLOCK hashes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Queries(shared.value, [], [])
        holding, some, total = np.zeros(len(asked.hashes), np.int64), 0, 0
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for part in byte_chunks([len(t) for t in texts]):
                sizes, slot, _, _ = asked.held(texts[part])
                holding += np.bincount(slot, minlength=len(holding))
                some, total = some + int((sizes > 0).sum()), total + int(sizes.sum())
        at = np.flatnonzero(holding)
        yield pa.record_batch([pa.array([-1, -2, *at], pa.int64()), pa.array([some, total, *holding[at]], pa.int64())], names=["slot", "n"])

    rows = docs.mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    found = {r["slot"]: r["n"] for r in rows}
    holding = np.zeros(len(queries.hashes), np.int64)
    for slot, n in found.items():
        if slot >= 0:
            holding[slot] = n
    return found.get(-1, 0), found.get(-2, 0), holding


def _block(docs: DataFrame, items: list, item_kind, k: int) -> DataFrame:
    queries = Queries.of([t for _, t in items])
    documents, total, holding = _counts(docs, queries)
    weights = np.array([weight(documents, int(n)) for n in holding], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((queries.hashes, queries.terms, queries.times, weights))
    kind = to_arrow_type(item_kind)
    item_ids = [i for i, _ in items]
    limit = max(1, SHARD_CELLS // max(1, len(queries.hashes)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weigh = Queries(*shared.value[:3]), shared.value[3]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in item_ids]
        for ids, texts in _shards(batches, limit):
            sizes, slot, doc, times = asked.held(texts)
            shard = Shard(len(asked.hashes), ids, slot, doc, impacts(weigh, slot, doc, times, sizes, documents, total))
            for n, (terms, often) in enumerate(zip(asked.terms, asked.times)):
                found[n] = shard.search(terms, often, k, *found[n])
        n = np.repeat(np.arange(len(found)), [len(s) for s, _ in found])
        scores = np.concatenate([s for s, _ in found]) if found else np.zeros(0, np.int64)
        ids = np.concatenate([i for _, i in found]) if found else np.zeros(0, np.int64)
        yield pa.record_batch(
            [pa.array(n, pa.int64()), pa.array([item_ids[i] for i in n], kind), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores, pa.int64())],
            names=["n", "item_id", "doc_id", "score"],
        )

    heads = docs.mapInArrow(search, f"n bigint, item_id {item_kind.simpleString()}, doc_id bigint, score bigint")
    order = Window.partitionBy("n").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = heads.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Documents in lists of at most ``limit`` and about ``SHARD_BYTES`` of text."""
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for key, text in zip(batch.column(0).fill_null(NO_ID).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            if not text:
                continue
            if texts and (size + len(text) > SHARD_BYTES or len(texts) == limit):
                yield np.array(ids, np.int64), texts
                ids, texts, size = [], [], 0
            ids.append(key)
            texts.append(text)
            size += len(text)
    if texts:
        yield np.array(ids, np.int64), texts


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents for each item, scores above 0 only: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    kind = items.schema[item_col].dataType
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).distinct()
    results, held, size = [], [], 0
    for row in asked.toLocalIterator():
        if not row["text"]:
            continue
        terms = len(row["text"]) // 2 + 1  # no text has more
        if held and size + terms > BLOCK:
            results.append(_block(read, held, kind, k))
            held, size = [], 0
        held.append((row["item"], row["text"]))
        size += terms
    if held:
        results.append(_block(read, held, kind, k))
    if not results:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id bigint, score bigint")
    out = results[0] if len(results) == 1 else checkpointed(results[0])
    for more in results[1:]:
        out = out.unionByName(checkpointed(more))
    return out
