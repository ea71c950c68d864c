"""Periodic runs of words, found by recompression.

A text's words become numbers, and blocks of one symbol and pairs of neighbours are replaced in turn, until each text
is one symbol: a run-length grammar with one level per step. The longest common extension of two places climbs
the levels while the symbols from both places are equal, skips what is equal, and comes down where they differ; its
end is a pair of different words, so it is exact.

A run with period q and ``exponent`` q words or more holds a place i, a multiple of q, from which a whole gram of words
equals that at i + q. Those places of the grid (all q, all multiples) are the candidates; two extensions, to the right
and to the left, give the run of each. Of the periods found for the same words the smallest is the run's.

Words are the runs between blanks (``[\\x20\\x09-\\x0D]``), compared by 64-bit hashes. A word is dropped from the collapsed text
if a run has it after the run's first period. Defined results: a null or empty text, or one of blanks, has no words, no runs
and an empty collapsed text. Rows are independent of each other, whatever their ids; only the columns named are read.
Nothing is shuffled. A task holds about 2 MB of texts at a time, or a single longer text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.llm.common import GOLDEN, Words, byte_chunks, mix, weights

MIN_LENGTH, EXPONENT = 24, 3
GRID = 1 << 20  # candidates handled at once
CHUNK = 1 << 21  # bytes of text handled at once


def gram_size(min_length: int) -> int:
    """The longest gram that any run of exponent 3 and this length has at a place of its grid.

    A run of length l matches itself, q further on, at l - q places, so l - q - g + 1 of them begin a matching gram; one is a
    multiple of q if there are q of them, so l >= 2q + g - 1 is enough: given by l >= 3q for q >= g - 1, else by l >= 3g - 5.
    """
    return max(1, (min_length + 5) // 3)


class Grammar:
    """Levels of all texts of a chunk, one flat array per property, level after level.

    Every level has a barrier before the first text and one after each text; barriers are never combined or equal.
    ``parent`` is the symbol above, ``first`` and ``last`` the outermost symbols below, ``start`` and ``size`` the words
    covered, ``right`` and ``left`` the number of equal symbols from here on and up to here.
    """

    def __init__(self, texts: Sequence[np.ndarray]):
        words, place = [np.array([-1])], []
        at = 1
        for i, t in enumerate(texts):
            place.append(at)
            words += [t, np.array([-2 - i])]
            at += len(t) + 1
        #: Where each text begins.
        self.place = np.array(place, np.int64)
        symbols = np.concatenate(words).astype(np.int64)
        start, size = np.arange(len(symbols)), np.ones(len(symbols), np.int64)
        fresh = int(symbols.max(initial=0)) + 1
        levels: list[dict] = []
        offset = turn = 0
        first = last = np.full(len(symbols), -1, np.int64)
        while True:
            blocks = np.concatenate([[0], np.flatnonzero(symbols[1:] != symbols[:-1]) + 1])
            runs = np.diff(np.append(blocks, len(symbols)))
            index = np.arange(len(symbols))
            head = np.repeat(blocks, runs)
            level = {"symbol": symbols, "start": start, "size": size, "first": first, "last": last}
            level |= {"left": index - head + 1, "right": head + np.repeat(runs, runs) - index}
            levels.append(level)
            if len(symbols) <= 2 * len(texts) + 1:
                level["parent"] = np.full(len(symbols), -1, np.int64)
                break
            if len(blocks) < len(symbols):  # block compression
                cut, key = blocks, symbols[blocks]
                joined = np.flatnonzero(runs > 1)
                pair = np.column_stack([key[joined], runs[joined]])
            else:  # pair compression: symbols of one side with a following one of the other side
                turn += 1
                side = mix(symbols.astype(np.uint64) * np.uint64(2) + weights(turn, 13)[-1]) >> np.uint64(63)
                real = symbols >= 0
                fits = real[:-1] & real[1:] & (side[:-1] < side[1:])
                other = real[:-1] & real[1:] & (side[:-1] > side[1:])
                fits = fits if fits.sum() >= other.sum() else other
                begins = np.flatnonzero(fits)
                keep = np.ones(len(symbols), bool)
                keep[begins + 1] = False
                cut = np.flatnonzero(keep)
                key = symbols[cut]
                joined = np.searchsorted(cut, begins)
                pair = np.column_stack([symbols[begins], symbols[begins + 1]])
            code = pair[:, 0] * (1 << 31) + pair[:, 1]
            _, name = np.unique(code, return_inverse=True)
            symbols = key.copy()
            symbols[joined] = fresh + name
            fresh += int(name.max(initial=-1)) + 1
            counts = np.diff(np.append(cut, len(index)))
            level["parent"] = offset + len(index) + np.repeat(np.arange(len(cut)), counts)
            first, last = offset + cut, offset + cut + counts - 1
            start = start[cut]
            size = np.add.reduceat(size, cut)
            offset += len(index)
        for name in levels[0]:
            setattr(self, name, np.concatenate([lv[name] for lv in levels]))

    def extension(self, one: np.ndarray, other: np.ndarray, right: bool) -> np.ndarray:
        """Equal words from two places of one text each on, to the right, or up to them, to the left."""
        outer, equal = (self.first, self.right) if right else (self.last, self.left)
        symbol, parent = self.symbol, self.parent
        found = np.zeros(len(one), np.int64)
        live = np.arange(len(one))
        a, b, begin = one.copy(), other.copy(), one.copy()
        sign = 1 if right else -1
        while len(live):
            up_a, up_b = parent[a], parent[b]
            same = symbol[a] == symbol[b]
            rise = same & (up_a >= 0) & (up_b >= 0)
            rise &= (outer[up_a] == a) & (outer[up_b] == b) & (symbol[up_a] == symbol[up_b])
            skip = np.where(same & ~rise, sign * np.minimum(equal[a], equal[b]), 0)
            below = outer[a]
            sink = ~same & (below >= 0) & (symbol[a] >= 0) & (symbol[b] >= 0)
            done = ~same & ~sink
            if done.any():
                # A barrier keeps its place on all levels: it begins where the text ends and ends where it begins.
                at = a[done]
                edge = self.start[at] if right else self.start[at] + self.size[at] - 1
                found[live[done]] = sign * (edge - begin[done])
            a = np.where(rise, up_a, np.where(sink, below, a + skip))
            b = np.where(rise, up_b, np.where(sink, outer[b], b + skip))
            rest = ~done
            live, a, b, begin = live[rest], a[rest], b[rest], begin[rest]
        return found


def candidates(grams: np.ndarray, again: np.ndarray, n: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the harmonic grid of a text of ``n`` words where a gram is repeated one period on.

    ``grams`` has the hash of the gram at each place and ``again`` whether it occurs elsewhere in the text.
    """
    low, last = 1, min(n // EXPONENT, len(grams) - 1)
    while low <= last:
        high = low
        total = 0
        while high <= last and total < GRID:  # periods low to high - 1, about GRID places
            step = min(last - high + 1, max(1, (GRID - total) * high // (len(grams) + 1)))
            total += step * ((len(grams) - 1 - high) // high + 1)
            high += step
        periods = np.arange(low, high)
        counts = (len(grams) - 1 - periods) // periods + 1
        q = np.repeat(periods, counts)
        i = (np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)) * q
        fits = again[i]
        i, q = i[fits], q[fits]
        fits = grams[i] == grams[i + q]
        if fits.any():
            yield i[fits], q[fits]
        low = high


def runs_of(words: Sequence[np.ndarray], hits: Sequence[tuple[int, np.ndarray, np.ndarray]], min_length: int) -> dict[int, np.ndarray]:
    """Runs (start, length, period) by text from the candidates (text, places, periods)."""
    if not hits:
        return {}
    used = sorted({t for t, _, _ in hits})
    rank = {t: n for n, t in enumerate(used)}
    _, letters = np.unique(np.concatenate([words[t] for t in used]), return_inverse=True)
    sizes = np.cumsum([0, *(len(words[t]) for t in used)])
    grammar = Grammar([letters[a:b] for a, b in zip(sizes, sizes[1:])])
    rows = []
    for text, i, q in hits:
        base = grammar.place[rank[text]]
        ahead = grammar.extension(base + i, base + i + q, True)
        back = grammar.extension(base + i - 1, base + i + q - 1, False)
        length = ahead + back + q
        fine = length >= np.maximum(min_length, EXPONENT * q)
        rows.append(np.unique(np.column_stack([np.full(fine.sum(), text), (i - back)[fine], length[fine], q[fine]]), axis=0))
    table = np.unique(np.concatenate(rows), axis=0)
    new = np.ones(len(table), bool)  # of rows with the same words, the first has the smallest period
    new[1:] = (table[1:, :3] != table[:-1, :3]).any(axis=1)
    table = table[new]
    table = table[np.lexsort((table[:, 3], table[:, 1], table[:, 0]))]
    return {t: table[table[:, 0] == t, 1:] for t in np.unique(table[:, 0]).tolist()}


def chunk_runs(texts: Sequence[bytes], min_length: int = MIN_LENGTH) -> dict[int, np.ndarray]:
    """Runs of each text that has any."""
    gram = gram_size(min_length)
    words = Words(texts)
    sizes = np.diff(words.bounds)
    grams = words.windows(gram, range(gram), salt=13)
    owner = np.repeat(np.arange(len(texts)), np.maximum(sizes - gram + 1, 0))
    counts = np.bincount(owner, minlength=len(texts))
    begin = np.cumsum(counts) - counts
    grams = grams[words.bounds[:-1][owner] + np.arange(len(owner)) - begin[owner]] if len(owner) else np.zeros(0, np.uint64)
    own = mix(grams + owner.astype(np.uint64) * GOLDEN)
    order = np.argsort(own)
    twin = own[order][1:] == own[order][:-1]
    again = np.zeros(len(own), bool)
    again[order[1:][twin]] = True
    again[order[:-1][twin]] = True
    hits = []
    for t in np.unique(owner[again]).tolist():
        span = slice(begin[t], begin[t] + counts[t])
        hits += [(t, i, q) for i, q in candidates(grams[span], again[span], int(sizes[t]), gram)]
    each = [words.hashes[a:b] for a, b in zip(words.bounds, words.bounds[1:])]
    return runs_of(each, hits, min_length)


def collapsed(words: Sequence[bytes], runs: np.ndarray) -> bytes:
    """The words, without those that a run has after its first period, joined by one space."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per document: id, ``n_words``, ``runs`` by start and period (all of ``min_length`` words and three periods or
    more, as long as they can be), and ``collapsed``, the text without the repetitions."""
    if min_length < 1:
        raise ValueError("min_length must be 1 or more")
    names = [id_col, "n_words", "runs", "collapsed"]
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for part in byte_chunks([len(t) for t in texts], CHUNK):
                found = chunk_runs(texts[part], min_length)
                words = [t.split() for t in texts[part]]
                table = np.concatenate([found[t] for t in sorted(found)]) if found else np.zeros((0, 3), np.int64)
                counts = [len(found[t]) if t in found else 0 for t in range(len(words))]
                kept = [collapsed(w, found[t]) if t in found else b" ".join(w) for t, w in enumerate(words)]
                columns = [pa.array(table[:, c], pa.int64()) for c in range(3)]
                runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(run)))
                yield pa.record_batch(
                    [batch.column(0)[part], pa.array(list(map(len, words)), pa.int64()), runs, pa.array(kept, pa.binary()).cast(pa.string())],
                    names=names,
                )

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return df.select(id_col, text_col).mapInArrow(compute, schema)
