"""Removal of byte strings that an earlier document already has, by sorting suffixes.

Two documents that share ``length`` bytes share the smallest ``SEED``-byte hash inside them, at the same
place. Each document is cut into runs of consecutive ``length``-byte windows with the same smallest seed (the
anchor), so every window is in one run and equal windows are in runs with equal anchors.

Texts are stored once, compressed, in blocks of whole documents; every later step reads blocks, finds their
runs again and sends only what other blocks must know. Within a block equal runs are one. What goes between
blocks is dealt by hashed anchor into buckets, whose number grows with the text, one compressed row per block
and bucket.

1. The anchors of every block go to their buckets, which tell each block which of its anchors two documents or
   more have, and which have more than SHARD bytes of runs (heavy ones).
2. The blocks send the bytes and smallest document of the runs with such anchors. In a bucket equal runs are
   combined. Where an anchor has one run, its smallest document is that of all its windows; otherwise the
   suffixes of its runs are sorted: names stand for sorted prefixes, 8-byte names come from the bytes, and
   tuples (name, name further on) sorted give the names of 16, 32 and ``length`` bytes, so the common prefix
   doubles at each level and sorted order is induced from the level before. Suffixes with one final name share
   ``length`` bytes; the smallest document of each is told to the blocks as ranges of windows.
   A heavy anchor would not fit a task. Its runs, of at most ``length`` - SEED + 1 windows each, are sent window
   by window instead, dealt by the bytes of the window, so that equal windows meet and no bucket has them all.
3. Every block puts the ranges on all places of its runs and cuts its documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import GOLDEN, _powers, checkpointed, mix, weights

SEED = 24
SEGMENT = 1 << 18  # window starts looked at together
PLACE_BITS = np.uint64(22)
SHARD = 1 << 21  # bytes of runs an anchor may have; anchors beyond are compared by windows
PART = 1 << 18  # bytes of runs whose suffixes are sorted at a time, whole anchors
BLOCK = 1 << 22  # bytes of whole documents stored together


def _segments(texts: Sequence[bytes], length: int) -> Iterator[tuple[int, int, bytes]]:
    """(text, first window, bytes) of pieces with at most SEGMENT windows each."""
    for k, text in enumerate(texts):
        for start in range(0, len(text) - length + 1, SEGMENT):
            yield k, start, text[start : start + SEGMENT + length - 1]


class Runs:
    """Runs of windows with one anchor: ``text``, ``first`` window, ``count``, ``anchor`` hash, ``sign`` of the bytes."""

    def __init__(self, texts: Sequence[bytes], length: int):
        parts, size, done = [], 0, []
        for segment in _segments(texts, length):
            if size and size + len(segment[2]) > 2 * SEGMENT:
                done.append(self._find(parts, length))
                parts, size = [], 0
            parts.append(segment)
            size += len(segment[2])
        if parts:
            done.append(self._find(parts, length))
        empty = [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 2
        self.text, self.first, self.count, self.anchor, self.sign = (np.concatenate(x) for x in zip(*(done or [empty])))

    @staticmethod
    def _find(parts: list[tuple[int, int, bytes]], length: int):
        buffer = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        sums, down = _sums(buffer)
        seeds = mix((sums[SEED:] - sums[:-SEED]) * down[: len(buffer) - SEED + 1])
        place = np.arange(len(seeds), dtype=np.uint64)
        # The smallest hash, the leftmost of equals: the place fills the low bits.
        low = ((seeds >> PLACE_BITS) << PLACE_BITS) | place
        window, reach = length - SEED + 1, 1
        while 2 * reach <= window:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < window:
            more = window - reach
            low = np.minimum(low[:-more], low[more:])
        at = (low & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
        sizes = np.array([len(p[2]) for p in parts])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        owner = np.repeat(np.arange(len(parts)), sizes - length + 1)
        start = np.arange(len(owner)) + np.repeat(begins - np.concatenate([[0], np.cumsum(sizes - length + 1)[:-1]]), sizes - length + 1)
        anchor = at[start]
        change = np.ones(len(owner), bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        head = np.flatnonzero(change)
        count = np.diff(np.append(head, len(owner)))
        piece = owner[head]
        text = np.array([p[0] for p in parts])[piece]
        first = start[head] - begins[piece] + np.array([p[1] for p in parts])[piece]
        sign = mix((sums[start[head] + count + length - 1] - sums[start[head]]) * down[start[head]])
        return text, first, count, seeds[anchor[head]], sign


def _sums(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums whose differences, times the second array at their start, are hashes of the bytes between."""
    up, down = _powers(len(buffer) + 1)
    values = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(values[buffer] * up[: len(buffer)], out=sums[1:])
    return sums, down


def _heads(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    change = np.ones(len(ordered), bool)
    change[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(change)


def _rows(buffer: np.ndarray, begin: np.ndarray, width: int) -> Iterator[tuple[slice, np.ndarray]]:
    """The ``width`` bytes from every place of ``begin``, some rows at a time; zeros follow the buffer."""
    wide = np.concatenate([buffer, np.zeros(width, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(wide, width)
    for k in range(0, len(begin), 1 << 15):
        some = slice(k, k + (1 << 15))
        yield some, view[begin[some]]


def _pieces(buffer: np.ndarray, begin: np.ndarray, size: np.ndarray) -> bytes:
    """The strings at ``begin`` of ``size`` bytes, one after another."""
    if not len(begin):
        return b""
    width = int(size.max())
    inside = np.arange(width)
    return b"".join(rows[inside < size[some, None]].tobytes() for some, rows in _rows(buffer, begin, width))


def _signs(buffer: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each of the strings that follow one another in ``buffer``, some at a time."""
    signs, at = np.empty(len(begin), np.uint64), 0
    while at < len(begin):
        upto = max(at + 1, int(np.searchsorted(begin, begin[at] + (1 << 19))))
        start, stop = begin[at:upto] - begin[at], begin[upto - 1] + size[upto - 1]
        sums, down = _sums(buffer[begin[at] : stop])
        signs[at:upto] = mix((sums[start + size[at:upto]] - sums[start]) * down[start])
        at = upto
    return signs


class Distinct:
    """Equal strings as one, equal by their bytes: ``order`` has the strings group by group, ``head`` where a group
    begins in it, ``group`` the group of each string. The first of a group in ``order`` is the first of all."""

    def __init__(self, buffer: np.ndarray, begin: np.ndarray, size: np.ndarray, sign: np.ndarray):
        sign = sign.copy()
        width = int(size.max()) if len(size) else 0
        while True:
            self.order = np.argsort(sign, kind="stable")
            self.head = _heads(sign[self.order])
            self.group = np.empty(len(sign), np.int64)
            self.group[self.order] = np.repeat(np.arange(len(self.head)), np.diff(np.append(self.head, len(sign))))
            first = self.order[self.head][self.group]
            again = np.flatnonzero(first != np.arange(len(sign)))
            odd = [again[size[again] != size[first[again]]]]
            again = again[size[again] == size[first[again]]]
            if len(again):
                inside = np.arange(width)
                left, right = _rows(buffer, begin[again], width), _rows(buffer, begin[first[again]], width)
                for (some, one), (_, two) in zip(left, right):
                    differs = ((one != two) & (inside < size[again[some], None])).any(axis=1)
                    odd.append(again[some][differs])
            odd = np.concatenate(odd)
            if not len(odd):
                return
            # Other bytes with the same sign: a sign of their own.
            sign[odd] = mix(sign[odd] + (odd.astype(np.uint64) + np.uint64(1)) * GOLDEN)


def _squeeze(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte plane by byte plane, compressed."""
    planes = (np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unsqueeze(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for kind, width in zip(kinds, widths):
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


class BlockRuns:
    """The documents of a block, their runs, and the distinct ones of these sorted by hashed anchor."""

    def __init__(self, row: pd.Series, length: int):
        self.data = zstandard.ZstdDecompressor().decompress(row["data"])
        self.ids, self.sizes = np.asarray(row["ids"]), np.asarray(row["sizes"], np.int64)
        stops = np.cumsum(self.sizes)
        self.begins = stops - self.sizes
        self.runs = Runs([self.data[a:b] for a, b in zip(self.begins.tolist(), stops.tolist())], length)
        self.buffer = np.frombuffer(self.data, np.uint8)
        self.begin = self.begins[self.runs.text] + self.runs.first
        self.same = Distinct(self.buffer, self.begin, self.runs.count + length - 1, self.runs.sign)
        self.names, rank = np.unique(self.ids, return_inverse=True)
        self.rank = rank[self.runs.text]  # of the run's document, in the order of ids
        ranks = self.rank[self.same.order]
        if len(ranks):
            self.least = np.minimum.reduceat(ranks, self.same.head)
            self.last = np.maximum.reduceat(ranks, self.same.head)
        else:
            self.least = self.last = ranks
        self.first = self.same.order[self.same.head]  # the run that stands for a group
        key = mix(self.runs.anchor[self.first])
        self.by_key = np.argsort(key, kind="stable")
        self.key = key[self.by_key]
        self.key_head = _heads(self.key)
        self.per_key = np.diff(np.append(self.key_head, len(self.key)))


def _dealt(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]:
    """Of sorted keys: the next 32 bits after the bucket's, and (bucket, its slice)."""
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
    head = _heads(bucket)
    slices = [slice(a, b) for a, b in zip(head.tolist(), [*head[1:].tolist(), len(key)])]
    return (key >> np.uint64(32 - bits)).astype(np.uint32), bucket, [(int(bucket[s.start]), s) for s in slices]


def _steps(rest: np.ndarray) -> np.ndarray:
    return np.diff(rest, prepend=np.uint32(0))


def suffix_names(buffer: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Names of the ``length``-byte prefixes of the suffixes at ``valid``: equal exactly if the bytes are.

    ``buffer`` has ``length`` bytes or more from every place of ``valid``. Names are in sorted order.
    """
    wide = np.zeros(len(buffer) + 8, np.uint8)
    wide[: len(buffer)] = buffer
    packed = np.zeros(len(buffer), np.uint64)
    for k in range(8):
        packed = (packed << np.uint64(8)) | wide[k : k + len(buffer)]
    name = np.unique(packed, return_inverse=True)[1].astype(np.uint64)
    reach = 8
    while reach < length:
        step = min(reach, length - reach)
        further = np.zeros(len(name), np.uint64)
        further[:-step or None] = name[step:]
        pair = (name << np.uint64(32)) | further
        if reach + step == length:
            return np.unique(pair[valid], return_inverse=True)[1]
        name = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        reach += step
    return np.unique(packed[valid], return_inverse=True)[1]


def _ranges(runs: pd.DataFrame, length: int) -> pd.DataFrame:
    """For each run: ranges of windows and the smallest document that has them, where ``last`` is not it."""
    sizes = runs["piece"].map(len).to_numpy()
    buffer = np.frombuffer(b"".join(runs["piece"]), np.uint8)
    begins = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(runs)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    names = suffix_names(buffer, begins[owner] + inside, length)
    mine = runs["least"].to_numpy()[owner]
    least = np.full(int(names.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, names, mine)
    least = least[names]
    head = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(least, prepend=-1) != 0))
    out = pd.DataFrame(
        {
            "group": runs["group"].to_numpy()[owner[head]],
            "at": inside[head],
            "windows": np.diff(np.append(head, len(owner))),
            "least": least[head],
        }
    )
    return out[least[head] < runs["last"].to_numpy()[owner[head]]]


def _compare(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Of a bucket's runs: per block, the ranges of windows that a smaller document of another block or run has."""
    parts = [_unsqueeze(d, np.uint32, np.uint32, np.uint16, np.uint16) for d in rows["data"]]
    key = np.concatenate([np.cumsum(p[0], dtype=np.uint32) for p in parts])
    run, offset, size = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (1, 2, 3))
    owner = np.repeat(np.arange(len(rows)), [len(p[0]) for p in parts])
    raw = b"".join(zstandard.ZstdDecompressor().decompress(d) for d in rows["pieces"])
    buffer = np.frombuffer(raw, np.uint8)
    begin = np.cumsum(size) - size
    names, own = np.unique(np.concatenate(rows["least"].tolist()), return_inverse=True)
    same = Distinct(buffer, begin, size, _signs(buffer, begin, size))
    least = np.minimum.reduceat(own[same.order], same.head)
    last = np.maximum.reduceat(own[same.order], same.head)
    first = same.order[same.head]
    by_key = np.argsort(key[first], kind="stable")
    head = _heads(key[first][by_key])
    per_key = np.diff(np.append(head, len(by_key)))
    alone = np.empty(len(by_key), bool)
    alone[by_key] = np.repeat(per_key == 1, per_key)
    # The only run of an anchor: all its windows have its smallest document.
    told = np.flatnonzero(alone[same.group] & (least[same.group] < own))
    found = [(told, np.zeros(len(told), np.int64), size[told] - length + 1, least[same.group[told]])]
    # Anchors of several runs, some whole anchors at a time.
    total = np.cumsum(np.where(alone[by_key], 0, size[first][by_key]))
    several = np.flatnonzero(per_key > 1)
    member_end = np.append(same.head[1:], len(same.order))
    at = 0
    while at < len(several):
        base = total[head[several[at]] - 1] if head[several[at]] else 0
        ends = head[several[at:]] + per_key[several[at:]] - 1
        upto = at + max(1, int(np.searchsorted(total[ends] - base, PART, side="right")))
        groups = np.concatenate([by_key[head[k] : head[k] + per_key[k]] for k in several[at:upto].tolist()])
        at = upto
        places = zip(begin[first[groups]].tolist(), (begin + size)[first[groups]].tolist())
        frame = pd.DataFrame({"group": groups, "piece": [raw[a:b] for a, b in places], "least": least[groups], "last": last[groups]})
        ranges = _ranges(frame, length)
        # To every row that has the run.
        group = ranges["group"].to_numpy()
        times = member_end[group] - same.head[group]
        which = np.repeat(np.arange(len(group)), times)
        member = same.order[np.repeat(same.head[group], times) + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)]
        lowest = ranges["least"].to_numpy()[which]
        tell = lowest < own[member]
        which = which[tell]
        found.append((member[tell], ranges["at"].to_numpy()[which], ranges["windows"].to_numpy()[which], lowest[tell]))
    member, start, windows, lowest = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((run[member], owner[member]))
    member, start, windows, lowest = member[order], start[order] + offset[member[order]], windows[order], lowest[order]
    cuts = _heads(owner[member])
    out = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(member)]):
        steps = _steps(run[member[a:b]].astype(np.uint32))
        data = _squeeze(steps, start[a:b].astype(np.uint16), windows[a:b].astype(np.uint16))
        out.append((rows["block"].iloc[owner[member[a]]], data, names[lowest[a:b]]))
    return pd.DataFrame(out, columns=["block", "data", "least"])


def _cut(block: BlockRuns, told: pd.DataFrame, length: int) -> pd.DataFrame:
    """The documents of a block without the bytes that an earlier document has."""
    runs, same = block.runs, block.same
    # Runs that a smaller document of the block has go whole.
    whole = np.flatnonzero(block.least[same.group] < block.rank)
    starts, stops = [block.begin[whole]], [block.begin[whole] + runs.count[whole] + length - 1]
    end = np.append(same.head[1:], len(same.order))
    for data, least in zip(told["data"], told["least"]):
        steps, at, windows = _unsqueeze(data, np.uint32, np.uint16, np.uint16)
        group = same.group[np.cumsum(steps, dtype=np.uint32)]
        times = end[group] - same.head[group]
        which = np.repeat(np.arange(len(group)), times)
        run = same.order[np.repeat(same.head[group], times) + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)]
        later = np.asarray(block.ids)[runs.text[run]] > np.asarray(least)[which]
        run, which = run[later], which[later]
        start = block.begin[run] + at[which].astype(np.int64)
        starts.append(start)
        stops.append(start + windows[which].astype(np.int64) + length - 1)
    # Ranges that overlap or touch become one, so that a byte's depth is 0 or 1.
    start, stop = np.concatenate(starts), np.concatenate(stops)
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    apart = np.ones(len(start), bool)
    apart[1:] = start[1:] > reach[:-1]
    depth = np.zeros(len(block.buffer) + 1, np.int8)
    depth[start[apart]] = 1
    depth[reach[np.append(apart[1:], True)[: len(reach)]]] = -1
    lost = np.cumsum(depth[:-1], dtype=np.int8).view(bool)
    opens = lost.copy()
    opens[1:] &= ~lost[:-1]
    opens[block.begins] = lost[block.begins]  # a removed run ends with its document
    removed = np.add.reduceat(lost, block.begins, dtype=np.int64)
    kept, stop = block.buffer[~lost].tobytes(), np.cumsum(block.sizes - removed).tolist()
    return pd.DataFrame(
        {
            "id": list(block.ids),
            "n_bytes": block.sizes,
            "n_removed": removed,
            "n_spans": np.add.reduceat(opens, block.begins, dtype=np.int64),
            "kept": [kept[a:b] for a, b in zip([0, *stop[:-1]], stop)],
        }
    )


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 50
) -> DataFrame:
    """(``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept``): the UTF-8 bytes that stay of each text.

    Every byte goes that is covered by a ``length``-byte string which also starts in a document with a smaller
    id; strings are judged on the input. ``n_spans`` counts maximal removed runs.

    A null text has no bytes. A document without an id loses nothing and takes nothing from others. Rows that
    share an id are one document: they take nothing from each other, and a string that an earlier document has
    goes from each of them; each row is cut by its own text. An empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    usable = F.col("id").isNotNull() & F.col("text").isNotNull() & (F.length("text") >= length)

    def stored(batches):
        """Whole documents up to about BLOCK bytes as one row."""
        part, seq, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pd.DataFrame:
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            out = ((part << 32) + seq, size, list(ids), [len(t) for t in texts], data)
            return pd.DataFrame([out], columns=["block", "bytes", "ids", "sizes", "data"])

        for batch in batches:
            for key, text in zip(batch["id"], batch["text"]):
                ids.append(key)
                texts.append(text)
                size += len(text)
                if size >= BLOCK:
                    yield row()
                    seq, ids, texts, size = seq + 1, [], [], 0
        if ids:
            yield row()

    shape = f"block bigint, bytes bigint, ids array<{kind}>, sizes array<bigint>, data binary"
    blocks = checkpointed(source.where(usable).mapInPandas(stored, shape))
    size = blocks.agg(F.sum("bytes")).first()[0] or 0
    # About 16 MB of text to a bucket; more buckets than tasks for small tables too.
    bits = max(1, min(7, (size >> 20).bit_length()), (size >> 24).bit_length())

    def anchors(batches):
        for batch in batches:
            for _, row in batch.iterrows():
                block = BlockRuns(row, length)
                if not len(block.key):
                    continue
                several = np.minimum.reduceat(block.least[block.by_key], block.key_head) < np.maximum.reduceat(
                    block.last[block.by_key], block.key_head
                )
                rest, _, slices = _dealt(block.key[block.key_head], bits)
                count = np.minimum(block.per_key, 65535).astype(np.uint16)
                data = [(b, row["block"], _squeeze(_steps(rest[s]), count[s], several[s].astype(np.uint8))) for b, s in slices]
                yield pd.DataFrame(data, columns=["bucket", "block", "data"])

    def judged(rows: pd.DataFrame) -> pd.DataFrame:
        """Of each anchor of each block: 0 if one document has it, 2 if it is heavy, else 1."""
        parts = [_unsqueeze(d, np.uint32, np.uint16, np.uint8) for d in rows["data"]]
        key = np.concatenate([np.cumsum(p[0], dtype=np.uint32) for p in parts])
        which = np.unique(key, return_inverse=True)[1]
        several = np.bincount(which, weights=np.concatenate([p[2] for p in parts])) > 0
        heavy = np.bincount(which, weights=np.concatenate([p[1] for p in parts])) * (2 * length - SEED) > SHARD
        verdict = (((np.bincount(which) > 1) | several) * (1 + heavy)).astype(np.uint8)[which]
        stops = np.cumsum([len(p[0]) for p in parts]).tolist()
        data = [_squeeze(verdict[a:b]) for a, b in zip([0, *stops[:-1]], stops)]
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "data": data})

    verdicts = (
        blocks.select("block", "ids", "sizes", "data")
        .mapInPandas(anchors, "bucket int, block bigint, data binary")
        .groupBy("bucket")
        .applyInPandas(judged, "block bigint, bucket int, data binary")
    )

    def dealt(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "block", "data", "pieces", "least"]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=columns)
        block = BlockRuns(left.iloc[0], length)
        verdict = np.concatenate([_unsqueeze(d, np.uint8)[0] for d in right.sort_values("bucket")["data"]])
        verdict = np.repeat(verdict, block.per_key)
        light, heavy = block.by_key[verdict == 1], block.by_key[verdict == 2]
        # Heavy anchors: every window by itself, dealt by its bytes.
        windows = block.runs.count[block.first[heavy]]
        heavy = np.repeat(heavy, windows)
        inside = np.arange(len(heavy)) - np.repeat(np.cumsum(windows) - windows, windows)
        salted, window_key = weights(length, 9), np.zeros(len(heavy), np.uint64)
        for some, rows in _rows(block.buffer, block.begin[block.first[heavy]] + inside, length):
            window_key[some] = mix((mix(rows + GOLDEN) * salted).sum(axis=1, dtype=np.uint64))
        key = np.concatenate([block.key[verdict == 1], window_key])
        order = np.argsort(key, kind="stable")
        group = np.concatenate([light, heavy])[order]
        offset = np.concatenate([np.zeros(len(light), np.int64), inside])[order]
        run = block.first[group]
        lengths = np.concatenate([block.runs.count[block.first[light]] + length - 1, np.full(len(heavy), length)])[order]
        begin, least = block.begin[run] + offset, block.names[block.least[group]]
        rest, _, slices = _dealt(key[order], bits)
        squeezer, out = zstandard.ZstdCompressor(level=1), []
        for bucket, s in slices:
            data = _squeeze(_steps(rest[s]), run[s].astype(np.uint32), offset[s].astype(np.uint16), lengths[s].astype(np.uint16))
            pieces = squeezer.compress(_pieces(block.buffer, begin[s], lengths[s]))
            out.append((bucket, left["block"].iloc[0], data, pieces, least[s]))
        return pd.DataFrame(out, columns=columns)

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        return _compare(rows, length)

    def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame([], columns=["id", "n_bytes", "n_removed", "n_spans", "kept"])
        return _cut(BlockRuns(left.iloc[0], length), right, length)

    by_block = blocks.select("block", "ids", "sizes", "data").groupBy("block")
    told = (
        by_block.cogroup(verdicts.groupBy("block"))
        .applyInPandas(dealt, f"bucket int, block bigint, data binary, pieces binary, least array<{kind}>")
        .groupBy("bucket")
        .applyInPandas(compared, f"block bigint, data binary, least array<{kind}>")
    )
    columns = f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    changed = by_block.cogroup(told.groupBy("block")).applyInPandas(cut, columns)
    idle = source.where(~usable | F.col("id").isNull() | F.col("text").isNull()).select(
        "id",
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"),
        F.coalesce("text", F.lit(b"")).alias("kept"),
    )
    return changed.unionByName(idle).withColumnRenamed("id", id_col)
