"""Helpers shared by the training-data operators: tables, worker state, vectorised word hashing."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import checkpointed

__all__ = ["checkpointed", "table", "small_batches", "fresh", "worker_state", "mix", "Words", "byte_chunks"]

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MULTIPLIER = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2^64
BLANK_BYTES = bytes([0x20, *range(0x09, 0x0E)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have rows with whole texts reach Python ``rows`` at a time, unless the session asks for a size itself."""
    key, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, str(rows))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def worker_state(name: str) -> dict:
    """A dict that lives in the Python worker for later tasks of the same operator.

    Only one operator's is kept: what the one before held goes when another asks for its own.
    """
    module = sys.modules.setdefault("_ledgerlens_worker", types.ModuleType("_ledgerlens_worker"))
    if module.__dict__.get("operator") != name:
        module.__dict__.update(operator=name, state={})
    return module.__dict__["state"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def weights(n: int, salt: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers that depend on ``salt`` alone."""
    start = np.uint64(salt * 0xA24BAED4963EE407 % (1 << 64))
    return mix(start + np.arange(1, n + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    module = sys.modules.setdefault("_ledgerlens_worker", types.ModuleType("_ledgerlens_worker"))
    state = module.__dict__.setdefault("powers", {})
    if state.get("n", 0) < n:
        n = max(n, 1 << 20)
        for key, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
            factors = np.full(n, base, dtype=np.uint64)
            factors[0] = 1
            state[key] = np.multiply.accumulate(factors)
        state["n"] = n
    return state["up"], state["down"]


class Words:
    """64-bit hashes of the words of several texts.

    Words are the runs between separator bytes. ``hashes`` has the words of all texts in order and
    ``bounds[i] : bounds[i + 1]`` those of text ``i``.
    """

    def __init__(self, texts: Sequence[bytes], separators: bytes = BLANK_BYTES):
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        buffer = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        inside = np.ones(256, bool)
        inside[list(separators)] = False
        solid = inside[buffer]
        edge = np.flatnonzero(np.diff(solid, prepend=False))
        starts, ends = edge[0::2], edge[1::2]
        values = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
        values[~inside] = 0
        up, down = _powers(len(buffer) + 1)
        sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(values[buffer] * up[: len(buffer)], out=sums[1:])
        self.hashes = mix((sums[ends] - sums[starts]) * down[starts])
        self.bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
        self.starts, self.ends = starts, ends

    def windows(self, span: int, picked: Sequence[int], salt: int) -> np.ndarray:
        """A hash of the words at offsets ``picked`` from each word; valid where ``span`` words follow."""
        n = max(0, len(self.hashes) - span + 1)
        total = np.zeros(n, np.uint64)
        for offset, weight in zip(picked, weights(len(picked), salt)):
            total += self.hashes[offset : offset + n] * weight
        return mix(total)


def byte_chunks(sizes: Sequence[int], most: int = 1 << 21) -> Iterator[slice]:
    """Slices of consecutive texts with about ``most`` bytes each, one text at least."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield slice(start, i)
            start, total = i, 0
        total += size + 1
    if start < len(sizes):
        yield slice(start, len(sizes))


FILTER_CHUNK = 1 << 12


class KeyFilter:
    """A bit filter over 64-bit keys, made by Spark and read in tasks; it may let other keys through.

    Its size is set by the number of keys and is at most ``MOST_BITS / 8`` bytes.
    """

    LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29

    def __init__(self, keys: DataFrame):
        """``keys`` has one bigint column, ``key``."""
        bits, n = self.LEAST_BITS, keys.count()
        while bits < self.MOST_BITS and bits < 16 * n:
            bits *= 2
        span = 8 * FILTER_CHUNK

        def slots(batches):
            for batch in batches:
                both = np.concatenate(_filter_slots(batch["key"].to_numpy(), bits)).astype(np.int64)
                yield pd.DataFrame({"chunk": both // span, "bit": both % span}).drop_duplicates()

        def fill(rows: pd.DataFrame) -> pd.DataFrame:
            mark = np.zeros(span, np.uint8)
            mark[rows["bit"]] = 1
            data = np.packbits(mark, bitorder="little").tobytes()
            return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "data": [data]})

        filled = np.zeros((-(-bits // span), FILTER_CHUNK), np.uint8)
        marked = keys.mapInPandas(slots, "chunk bigint, bit bigint").distinct()
        for row in marked.groupBy("chunk").applyInPandas(fill, "chunk bigint, data binary").toLocalIterator():
            filled[row["chunk"]] = np.frombuffer(row["data"], np.uint8)
        self.bits = bits
        self.table = keys.sparkSession.sparkContext.broadcast(filled.ravel())

    def passes(self, keys: np.ndarray) -> np.ndarray:
        table, hit = self.table.value, np.ones(len(keys), bool)
        for slot in _filter_slots(keys, self.bits):
            hit &= (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return hit


def _filter_slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    keys, low = mix(keys.astype(np.int64).view(np.uint64)), np.uint64(bits - 1)
    return keys & low, mix(keys + GOLDEN) & low
