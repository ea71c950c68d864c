"""Document fingerprints by winnowing.

Every run of ``gram`` code points has a rolling hash; of every ``window`` consecutive hashes the smallest is a
print, the rightmost among equals. Two texts that share ``gram + window - 1`` code points in a row share a print
(``guarantee``). A print keeps its position, so a shared print also tells where the texts agree.

Defined results: a null text is an empty one, which has no print; a text shorter than ``gram`` has one print, the hash
of all of it; one with fewer than ``window`` hashes has the smallest of them. Only the columns named are read, so
others may have any name. Rows that repeat, or repeat an id, each get their own result; a null id sorts first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import GOLDEN, _powers, byte_chunks, mix

GRAM, WINDOW = 20, 31
LOW = np.uint64(0xFFFFFFFF)


def guarantee(gram: int = GRAM, window: int = WINDOW) -> int:
    """Texts that share so many code points in a row share a print."""
    return gram + window - 1


def rolling_hashes(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """32-bit hashes of the stretches of ``codes`` that begin at ``starts`` and have the lengths ``sizes``."""
    up, down = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + GOLDEN) * up[: len(codes)], out=sums[1:])
    return mix((sums[starts + sizes] - sums[starts]) * down[starts] + sizes.astype(np.uint64)) >> np.uint64(32)


def window_minima(keys: np.ndarray, window: int) -> np.ndarray:
    """The smallest of ``window`` keys from each place, by doubling."""
    span, low = 1, keys
    while 2 * span <= window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = window - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def prints(texts: Sequence[str], gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and positions of the prints of all texts, and where each text's prints begin (one bound more)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    grams = np.where(lengths >= gram, lengths - gram + 1, np.minimum(lengths, 1))  # hashes of each text
    first = np.concatenate([[0], np.cumsum(grams)])
    owner = np.repeat(np.arange(len(texts)), grams)
    place = np.arange(first[-1]) - first[owner]
    hashes = rolling_hashes(codes, (ends - lengths)[owner] + place, np.minimum(lengths, gram)[owner])
    # The place counts down in the low half, so that the smallest key is the rightmost of the smallest hashes.
    keys = (hashes << np.uint64(32)) | (LOW - place.astype(np.uint64))
    low = np.zeros(0, np.uint64)
    at = np.zeros(0, np.int64)
    if len(keys) >= window:
        starts = np.flatnonzero(place + window <= grams[owner])
        low, at = window_minima(keys, window)[starts], owner[starts]
    few = np.flatnonzero((grams > 0) & (grams < window))
    if len(few):
        edges = np.ravel(np.column_stack([first[few], first[few + 1]]))
        padded = np.append(keys, ~np.uint64(0))
        low = np.concatenate([low, np.minimum.reduceat(padded, edges)[::2]])
        at = np.concatenate([at, few])
        order = np.argsort(at, kind="stable")
        low, at = low[order], at[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1])
    low, at = low[new], at[new]
    bounds = np.searchsorted(at, np.arange(len(texts) + 1))
    return (low >> np.uint64(32)).astype(np.int64), (LOW - (low & LOW)).astype(np.int64), bounds


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Shared distinct prints over all distinct prints; 1 if neither has any."""
    one, other = set(one.tolist()), set(other.tolist())
    return len(one & other) / len(one | other) if one or other else 1.0


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """One row per document: id, ``hashes`` and ``positions`` of its prints in text order."""
    kind = df.schema[id_col].dataType

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in byte_chunks([4 * len(t) for t in texts], 1 << 23):
                hashes, places, bounds = prints(texts[part], gram, window)
                offsets = pa.array(bounds, pa.int32())
                yield pa.record_batch(
                    [batch.column(0)[part], *(pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (hashes, places))],
                    names=[id_col, "hashes", "positions"],
                )

    schema = f"`{id_col}` {kind.simpleString()}, hashes array<bigint>, positions array<bigint>"
    return df.select(id_col, text_col).mapInArrow(compute, schema)


def in_succession(df: DataFrame, id_col: str, text_col: str, parts: int | None = None) -> DataFrame:
    """All texts in ascending order of id (then of the text's hash), dealt out by ranges of ids.

    Columns: ``slot``, ``border``, ``id``, ``tie``, ``text``; a slot's rows are together in one partition, in order.
    After a slot's own rows (``border`` 0) comes the first row of the next slot that has any (``border`` 1; after the
    last slot that of the first), so every row's successor is in its partition. Texts are shuffled once; what
    reaches the driver is one cut and one first key per slot, 4 slots per shuffle partition.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    at = F.coalesce(F.col("id").cast("double"), F.lit(float("-inf")))
    probabilities = [i / (4 * parts) for i in range(1, 4 * parts)]
    cuts = rows.select(F.percentile_approx(at, probabilities, 20_000)).first()[0] or []
    edges = [float("-inf"), *sorted({c for c in cuts if c != float("-inf")}), float("inf")]
    if len(edges) > 2:
        cut = Bucketizer(splits=edges, inputCol="at", outputCol="slot")
        rows = cut.transform(rows.withColumn("at", at)).drop("at").withColumn("slot", F.col("slot").cast("int"))
    else:
        rows = rows.withColumn("slot", F.lit(0))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    least = rows.groupBy("slot").agg(F.min(F.struct("id", "tie")).alias("k")).select("slot", "k.*").collect()
    least = sorted(least, key=lambda r: r["slot"])
    table = [(r["slot"], r["id"], r["tie"], least[i - 1]["slot"]) for i, r in enumerate(least)]
    kind = df.schema[id_col].dataType.simpleString()
    heads = spark.createDataFrame(table, f"slot int, head {kind}, head_tie bigint, before int")
    dealt = rows.join(F.broadcast(heads), "slot")  # a row per slot
    own = F.struct(F.col("slot").alias("slot"), F.lit(0).alias("border"))
    lent = F.struct(F.col("before").alias("slot"), F.lit(1).alias("border"))
    is_head = F.col("id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie"))
    dealt = dealt.select(F.explode(F.when(is_head, F.array(own, lent)).otherwise(F.array(own))).alias("p"), "id", "tie", "text")
    dealt = dealt.select("p.*", "id", "tie", "text")
    return dealt.repartition(parts, "slot").sortWithinPartitions("slot", "border", "id", "tie")


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[tuple], tuple | None]]:
    """Rows in lists of about ``most`` code points, each with the row that follows the list."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("slot", "border", "id", "text"))):
            if size > most:
                yield held, row
                held, size = [], 0
            row = (*row[:3], row[3] or "")
            held.append(row)
            size += len(row[3])
    if held:
        yield held, None


def tail_swapped(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by the first as many of ``following``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def successor_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Every document's prints, those of its text with the last quarter from the next document (``tail_swapped``), and how
    alike the three are.

    Columns: id, ``n_chars``, ``edited_sha256``, ``fingerprint`` and ``edited_fingerprint`` (8 hex digits per print, in
    text order), ``positions`` of the prints, ``near_edited``, ``near_next``. The next document of the last is the first.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "positions", "near_edited", "near_next"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for held, ahead in _chunks(batches, 1 << 20):
            rows = held + ([(*ahead[:3], ahead[3] or "")] if ahead else [])
            mine = [i for i in range(len(held)) if held[i][1] == 0]
            texts = [r[3] for r in rows]
            edited = [tail_swapped(texts[i], texts[i + 1]) for i in mine]
            hashes, places, bounds = prints(texts, gram, window)
            changed, _, edges = prints(edited, gram, window)
            whole, swapped = hashes.astype(">u4").tobytes().hex(), changed.astype(">u4").tobytes().hex()
            of = lambda i: hashes[bounds[i] : bounds[i + 1]]
            out: list[list] = [[] for _ in names]
            for n, i in enumerate(mine):
                for column, value in zip(
                    out,
                    (
                        rows[i][2],
                        len(texts[i]),
                        hashlib.sha256(edited[n].encode()).hexdigest(),
                        whole[8 * bounds[i] : 8 * bounds[i + 1]],
                        swapped[8 * edges[n] : 8 * edges[n + 1]],
                        places[bounds[i] : bounds[i + 1]],
                        likeness(of(i), changed[edges[n] : edges[n + 1]]),
                        likeness(of(i), of(i + 1)),
                    ),
                ):
                    column.append(value)
            kinds = kinds or [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.float64(), pa.float64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(df.schema[id_col].dataType)
    schema = (
        f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "positions array<bigint>, near_edited double, near_next double"
    )
    return in_succession(df, id_col, text_col).mapInArrow(compute, schema)
