"""An adaptive context-mixing range coder for token ids, in blocks that stand alone.

A block is cut into lanes, runs of consecutive ids, and the coder takes one id of every lane at a step, so
that numpy does the arithmetic of all lanes at once. All lanes of a block share one model, which is reset at
the start of the block and learns after every step:

* order 2 and order 1 predict one id each, the one that last followed the same two ids or the same id in any
  lane, with a confidence from 0 to 3;
* order 0 is a frequency table over all ids;
* the three are mixed by how often, at the same two confidences, the order-2 id, the order-1 id, or neither
  was right; one interval division codes which it is, a second one the id itself by order 0 if neither was.

The coder is a carry-less range coder with 64-bit low and range and 16-bit output words, one stream per
lane. A block holds the numbers of ids and lanes, the id limit, a crc32 of the ids and one of the rest, then the
word counts and the words of the lanes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"LLB2"
HEADER = "<4sIIIII"  # magic, ids, lanes, id limit, crc32 of the ids, crc32 of the rest
MOST_LANES, LANE = 8192, 256
HASH_BITS = 18
STEP, FLOOR = 24, 1  # what a seen id adds to order 0, and what every id has
DELAY, EAGER = 4, 8  # order 0 learns the ids it coded after so many steps, after each of the first ones
TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 40)
U16, U64 = np.uint64(16), np.uint64(64)
RULES = 32  # confidences of order 2 and order 1, and whether they agree


class CorruptBlock(ValueError):
    """A block whose checksum, header or length is wrong."""


class _Model:
    """What encoder and decoder know before a step; ``learn`` is the same on both sides.

    ``one`` and ``two`` hold 4 * predicted id + confidence. Rule r gives outcome k the interval from
    ``starts[3 * r + k]`` of ``rates[3 * r + k]`` in ``totals[3 * r]``.
    """

    def __init__(self, limit: int, lanes: int):
        self.one = np.zeros(limit + 1, np.int32)
        self.two = np.zeros(1 << HASH_BITS, np.int32)
        self.counts = np.full(limit, FLOOR, np.int64)
        self.sums = np.arange(limit + 1, dtype=np.int64) * FLOOR
        self.rates = np.tile(np.array([2, 2, 8], np.int64), RULES)
        self.last = np.full(lanes, limit, np.int64)  # ``limit`` stands for the start of a lane
        self.before = np.full(lanes, limit, np.int64)
        self.fresh: list[np.ndarray] = []
        self.step = 0
        self._share()

    def _share(self) -> None:
        rates = self.rates.reshape(RULES, 3)
        self.totals = np.repeat(rates.sum(axis=1), 3)  # by 3 * rule
        self.starts = (np.cumsum(rates, axis=1) - rates).ravel()

    def predict(self, n: int):
        """(order-2 slot, order-2 entry, order-1 entry, their ids, 3 * rule) of the first ``n`` lanes."""
        last = self.last[:n]
        slot = ((self.before[:n] * 40503 + last) * 2654435761 >> 8) & ((1 << HASH_BITS) - 1)
        two, one = self.two.take(slot), self.one.take(last)
        two_id, one_id = two >> 2, one >> 2
        rule = (_sure(two) << 2) + _sure(one) + ((two_id == one_id).view(np.int8) << 4)
        return slot, two, one, two_id, one_id, 3 * rule

    def learn(self, ids: np.ndarray, slot: np.ndarray, two: np.ndarray, one: np.ndarray, right_two: np.ndarray, right_one: np.ndarray, event: np.ndarray, fresh: np.ndarray) -> None:
        """``event`` is 3 * rule + outcome, ``fresh`` the ids that order 0 coded."""
        n = len(ids)
        last, new = self.last[:n], ids << 2
        for table, at, entry, right in ((self.two, slot, two, right_two), (self.one, last, one, right_one)):
            sure = _sure(entry)
            value = entry + np.where(right, sure < 3, -(sure > 0).view(np.int8))
            np.copyto(value, new, where=~right & (sure == 0))
            # One id of several lanes with the same context stays: the last lane's.
            table[at] = value
        self.rates += 2 * np.bincount(event, minlength=3 * RULES)
        self._share()
        if self.totals.max() > 4000:
            crowded = self.totals > 4000
            self.rates[crowded] = (self.rates[crowded] + 1) >> 1
            self._share()
        self.fresh.append(fresh)
        self.step += 1
        if self.step <= EAGER or len(self.fresh) == DELAY:
            seen = np.concatenate(self.fresh)
            self.fresh.clear()
            if len(seen):
                self.counts += np.bincount(seen, minlength=len(self.counts)) * STEP
                if self.sums[-1] + STEP * len(seen) > 1 << 22:
                    self.counts = np.maximum(self.counts >> 1, FLOOR)
                np.cumsum(self.counts, out=self.sums[1:])
        self.before[:n] = last
        self.last[:n] = ids


def _sure(entry: np.ndarray) -> np.ndarray:
    return entry.astype(np.int8) & 3


def _settled(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    return (low ^ (low + span)) < TOP


def _lanes(n: int) -> int:
    return max(1, min(MOST_LANES, n // LANE))


def _steps(n: int, lanes: int) -> tuple[np.ndarray, int]:
    """(length of each lane, longest first; the longest)."""
    base, more = divmod(n, lanes)
    length = np.full(lanes, base)
    length[:more] += 1
    return length, base + (more > 0)


def encode_block(ids: np.ndarray, limit: int) -> bytes:
    """The block of ``ids``, each in [0, ``limit``)."""
    ids = np.asarray(ids, np.int64)
    if len(ids) and not (0 <= ids.min() and ids.max() < limit):
        raise ValueError(f"an id is not in [0, {limit})")
    n = len(ids)
    lanes = _lanes(n)
    length, steps = _steps(n, lanes)
    model = _Model(limit, lanes)
    low = np.zeros(lanes, np.uint64)
    span = np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    words = np.zeros((lanes, 2 * steps + 8), np.uint16)
    used = np.zeros(lanes, np.int64)
    room = words.shape[1]
    flat, place = words.ravel(), np.arange(lanes) * room
    inside = np.arange(steps) < length[:, None]
    grid = np.zeros((lanes, steps), np.int32)
    grid[inside] = ids  # lane by lane
    grid = np.ascontiguousarray(grid.T)  # step by step
    for t in range(steps):
        m = lanes if t < steps - 1 else int((length == steps).sum())
        x = grid[t, :m]
        slot, two, one, two_id, one_id, triple = model.predict(m)
        right_two, right_one = x == two_id, x == one_id
        event = (triple + (~right_two).view(np.int8) * (2 - right_one.view(np.int8))).astype(np.intp)
        unit = span[:m] // model.totals.take(triple).view(np.uint64)
        low[:m] += unit * model.starts.take(event).view(np.uint64)
        span[:m] = unit * model.rates.take(event).view(np.uint64)
        fresh = np.flatnonzero(~(right_two | right_one))
        symbol = x.take(fresh).astype(np.intp)
        if len(fresh):
            unit = span.take(fresh) // np.uint64(model.sums[-1])
            low[fresh] += unit * model.sums.take(symbol).view(np.uint64)
            span[fresh] = unit * model.counts.take(symbol).view(np.uint64)
        model.learn(x, slot, two, one, right_two, right_one, event, symbol)
        settled = _settled(low[:m], span[:m])
        at = np.flatnonzero(settled | (span[:m] < BOTTOM))
        settled = settled.take(at)
        while len(at):
            some_low, some_span = low.take(at), span.take(at)
            if not settled.all():
                some_span = np.where(settled, some_span, (~some_low + np.uint64(1)) & (BOTTOM - np.uint64(1)))
            to = place.take(at)
            flat[to] = (some_low >> np.uint64(48)).astype(np.uint16)
            place[at] = to + 1
            some_low, some_span = some_low << U16, some_span << U16
            low[at], span[at] = some_low, some_span
            # Only a lane that has just given a word may have to give another.
            settled = _settled(some_low, some_span)
            again = np.flatnonzero(settled | (some_span < BOTTOM))
            at, settled = at.take(again), settled.take(again)
    used += place - np.arange(lanes) * room
    for _ in range(4 if n else 0):
        words[np.arange(lanes), used] = (low >> np.uint64(48)).astype(np.uint16)
        used += 1
        low <<= U16
    kept = words[np.arange(words.shape[1])[None, :] < used[:, None]]
    body = used.astype("<u4").tobytes() + kept.astype("<u2").tobytes()
    own = zlib.crc32(ids.astype("<u4").tobytes())
    return struct.pack(HEADER, MAGIC, n, lanes, limit, own, zlib.crc32(body)) + body


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block, as uint32. Raises CorruptBlock if it is not what was written."""
    if len(block) < struct.calcsize(HEADER):
        raise CorruptBlock("too short")
    magic, n, lanes, limit, own, rest = struct.unpack_from(HEADER, block)
    body = block[struct.calcsize(HEADER) :]
    if magic != MAGIC or zlib.crc32(body) != rest or lanes != _lanes(n) or len(body) < 4 * lanes:
        raise CorruptBlock("header or checksum")
    used = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    stream = np.frombuffer(body, "<u2", offset=4 * lanes)
    if used.sum() != len(stream):
        raise CorruptBlock("length")
    length, steps = _steps(n, lanes)
    stream = np.concatenate([stream, np.zeros(8, np.uint16)]).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum(used)[:-1]])
    grid = np.zeros((steps, lanes), np.int32)
    model = _Model(limit, lanes)
    low = np.zeros(lanes, np.uint64)
    span = np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    code = np.zeros(lanes, np.uint64)
    for _ in range(4 if n else 0):
        code = (code << U16) | stream[at]
        at = at + 1
    for t in range(steps):
        m = lanes if t < steps - 1 else int((length == steps).sum())
        slot, two, one, two_id, one_id, triple = model.predict(m)
        triple = triple.astype(np.intp)
        unit = span[:m] // model.totals.take(triple).view(np.uint64)
        ahead = code[:m] - low[:m]
        is_one = ahead >= unit * model.starts.take(triple + 1).view(np.uint64)
        is_new = ahead >= unit * model.starts.take(triple + 2).view(np.uint64)
        event = triple + is_one + is_new
        low[:m] += unit * model.starts.take(event).view(np.uint64)
        span[:m] = unit * model.rates.take(event).view(np.uint64)
        x = np.where(is_one, one_id, two_id)
        fresh = np.flatnonzero(is_new)
        symbol = fresh
        if len(fresh):
            some_low = low.take(fresh)
            unit = span.take(fresh) // np.uint64(model.sums[-1])
            value = np.minimum(((code.take(fresh) - some_low) // unit).view(np.int64), model.sums[-1] - 1)
            order = np.argsort(value)  # sorted values are found faster
            symbol = np.empty(len(fresh), np.int64)
            symbol[order] = np.searchsorted(model.sums, value.take(order), side="right") - 1
            x[fresh] = symbol
            low[fresh] = some_low + unit * model.sums.take(symbol).view(np.uint64)
            span[fresh] = unit * model.counts.take(symbol).view(np.uint64)
        grid[t, :m] = x
        model.learn(x, slot, two, one, x == two_id, x == one_id, event, symbol)
        settled = _settled(low[:m], span[:m])
        go = np.flatnonzero(settled | (span[:m] < BOTTOM))
        settled = settled.take(go)
        while len(go):
            some_low, some_span, where = low.take(go), span.take(go), at.take(go)
            if not settled.all():
                some_span = np.where(settled, some_span, (~some_low + np.uint64(1)) & (BOTTOM - np.uint64(1)))
            code[go] = (code.take(go) << U16) | stream.take(np.minimum(where, len(stream) - 1))
            at[go] = where + 1
            some_low, some_span = some_low << U16, some_span << U16
            low[go], span[go] = some_low, some_span
            settled = _settled(some_low, some_span)
            again = np.flatnonzero(settled | (some_span < BOTTOM))
            go, settled = go.take(again), settled.take(again)
    ids = np.ascontiguousarray(grid.T)[np.arange(steps) < length[:, None]].astype("<u4")
    if zlib.crc32(ids.tobytes()) != own:
        raise CorruptBlock("ids")
    return ids
