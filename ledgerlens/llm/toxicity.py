"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic text and one on ordinary text. A window is compressed
with both; what it saves with the toxic one is its gain. A window is one word between two copies of a
carrier that both dictionaries hold, so that the block is always compressed and the word alone makes the
difference. The numbers of windows at or above each of several gains, and the two largest gains, are
calibrated to a probability by logistic regression on the labelled sample.

Most of a toxic text is ordinary. Its toxic text, for the dictionary, is made of the words that a larger
share of toxic than of ordinary sample documents hold; near copies within the sample count once.

Fitting reads a bounded sample (``toxic_rows`` and ``ordinary_rows`` labelled rows with at most
``max_chars`` characters each, the smallest by a hash of their id); scoring reads every whole text in one
pass without a shuffle. Gains of words are kept per Python worker, up to ``MEMO`` words.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import BLANK_BYTES, Words, byte_chunks, worker_state

SEPARATORS = BLANK_BYTES + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CARRIER = b"0123456789!@#$%^&*()_+QWERTYUIOP"  # 32 bytes that no lower-cased word holds
LEVELS = (3, 4, 5, 6, 7, 8)
COUNT_CAP, GAIN_CAP = 4, 12
MEMO = 200_000  # entries of about 100 bytes per worker


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text, modulo ``parts``, is ``part``; false without an id."""
    number = F.crc32(doc_id.cast("string").cast("binary")) % parts
    return F.coalesce(number == part, F.lit(False))


def _raw(texts: Sequence[str | None]) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]


def _words(text: str | None) -> set[bytes]:
    lower = (text or "").lower().encode("utf-8", "surrogatepass")
    return set(lower.translate(bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))).split())


def _distinct(texts: Sequence[str | None]) -> list[str | None]:
    """Texts without near copies: of those that share one of their four smallest shingle hashes, one."""
    raw = _raw(texts)
    kept, seen = [], set()
    for part in byte_chunks([len(t) for t in raw]):
        words = Words(raw[part], SEPARATORS)
        shingles = words.windows(3, range(3), salt=11)
        for i, (start, stop) in enumerate(zip(words.bounds[:-1], words.bounds[1:])):
            least = np.sort(shingles[start : max(start, stop - 2)])[:4].tolist()
            if not seen.intersection(least):
                kept.append(texts[part.start + i])
            seen.update(least)
    return kept


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a dictionary trained on ``samples``; the samples themselves if they are few."""
    joined = b"".join(samples)
    if len(joined) <= size:
        return joined
    try:
        trained = zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return joined[-size:]
    return trained[-(size * 9 // 10) :]  # without the entropy tables at its head


@dataclass
class ToxicityModel:
    """Both dictionaries and the calibration. ``score`` of a text is in [0, 1]."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    offset: float

    @staticmethod
    def fit(toxic_texts: Sequence[str], ordinary_texts: Sequence[str], *, share: float = 0.015, ratio: float = 12.0, toxic_bytes: int = 12_000, ordinary_bytes: int = 8192) -> ToxicityModel:
        """Train on texts of either class. Without texts of one class every score is 0."""
        rng = random.Random(7)
        bad, good = _distinct(toxic_texts), _distinct(ordinary_texts)
        if not bad or not good:
            return ToxicityModel(b"", b"", np.zeros(len(LEVELS) + 2), -30.0)
        bad_count = Counter(w for t in bad for w in _words(t))
        good_count = Counter(w for t in good for w in _words(t))
        least = max(4, share * len(bad))
        telling = sorted(
            w
            for w, n in bad_count.items()
            if n >= least and (n + 0.5) / (len(bad) + 1) > ratio * (good_count[w] + 0.5) / (len(good) + 1)
        )
        samples = [b" " + w + b" " for w in telling for _ in range(min(bad_count[w], 1000))]
        rng.shuffle(samples)
        samples = [b"".join(samples[i : i + 16]) for i in range(0, len(samples), 16)]
        plain = [b" ".join(t.split()) for t in _raw(good[:2000])]
        plain = [t[i : i + 400] for t in plain for i in range(0, len(t), 400)]
        model = ToxicityModel(
            _dictionary(samples, toxic_bytes, 40),
            _dictionary(plain, ordinary_bytes, 64),
            np.zeros(len(LEVELS) + 2),
            0.0,
        )
        x = model.features([*bad, *good])
        y = np.concatenate([np.ones(len(bad)), np.zeros(len(good))])
        model._calibrate(x, y)
        return model

    def _calibrate(self, x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> None:
        """Ridge-penalised logistic regression by Newton steps."""
        x1 = np.column_stack([x, np.ones(len(x))])
        ridge = np.full(x1.shape[1], penalty)
        ridge[-1] = 1e-6
        w = np.zeros(x1.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
            gradient = x1.T @ (p - y) + ridge * w
            curve = (x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(ridge)
            step = np.linalg.solve(curve, gradient)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weights, self.offset = w[:-1], float(w[-1])

    def _compressors(self) -> tuple[dict, list]:
        state = worker_state("toxicity")
        key = (self.toxic, self.ordinary)
        if state.get("key") != key:
            settings = zstandard.ZstdCompressionParameters(
                window_log=17, hash_log=16, chain_log=16, search_log=6, min_match=4, target_length=64,
                strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False,
                write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            )
            made = []
            for content in key:
                raw = zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                made.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=settings))
            state.update(key=key, memo={}, compressors=made)
        return state["memo"], state["compressors"]

    def word_gains(self, words: list[bytes]) -> np.ndarray:
        """Bytes that each word's window saves with the toxic dictionary."""
        if not words:
            return np.empty(0, np.int64)
        _, made = self._compressors()
        windows = [CARRIER + b" " + w + b" " + CARRIER for w in words]
        size = np.fromiter((len(w) for w in windows), np.uint64, len(windows))
        at = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.uint64)
        joined = zstandard.BufferWithSegments(b"".join(windows), np.stack([at, size], axis=1).tobytes())
        toxic, ordinary = (
            np.fromiter((len(c) for c in m.multi_compress_to_buffer(joined)), np.int64, len(words)) for m in made
        )
        return ordinary - toxic

    def features(self, texts: Sequence[str | None]) -> np.ndarray:
        """Per text: windows at or above each gain level (capped), the two largest gains (capped)."""
        out = np.zeros((len(texts), len(LEVELS) + 2))
        if not self.toxic:
            return out
        raw = _raw(texts)
        memo, _ = self._compressors()
        for part in byte_chunks([len(t) for t in raw]):
            chunk = raw[part]
            words = Words(chunk, SEPARATORS)
            if not len(words.hashes):
                continue
            buffer = b"\n".join(chunk)
            names, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
            listed = names.tolist()
            new = [k for k, name in enumerate(listed) if name not in memo]
            found = self.word_gains([buffer[words.starts[first[k]] : words.ends[first[k]]] for k in new])
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = range(len(listed))
                found = self.word_gains([buffer[words.starts[f] : words.ends[f]] for f in first])
            memo.update(zip((listed[k] for k in new), found.tolist()))
            gains = np.fromiter(map(memo.__getitem__, listed), np.int64, len(listed))[back]
            sizes = np.diff(words.bounds)
            owner = np.repeat(np.arange(part.start, part.stop), sizes)
            telling = gains >= LEVELS[0]
            owner, gains = owner[telling], gains[telling]
            for column, level in enumerate(LEVELS):
                counts = np.bincount(owner[gains >= level], minlength=len(texts))
                out[:, column] += np.minimum(counts, COUNT_CAP)
            order = np.lexsort((-gains, owner))
            owner, gains = owner[order], np.minimum(gains[order], GAIN_CAP)
            head = np.flatnonzero(np.diff(owner, prepend=-1))
            out[owner[head], -2] = gains[head]
            second = head[np.diff(np.append(head, len(owner))) > 1] + 1
            out[owner[second], -1] = gains[second]
        return out

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        z = self.features(texts) @ self.weights + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    *,
    toxic_rows: int = 2000,
    ordinary_rows: int = 3000,
    max_chars: int = 20_000,
) -> ToxicityModel:
    """Fit on labelled rows. ``labels`` holds the ids to learn from; of repeated ids the largest label counts.

    Rows with a null id, text or label are left out. At most ``toxic_rows + ordinary_rows`` ids and their
    texts of at most ``max_chars`` characters reach the driver.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("int").alias("label"))
    )
    chosen = {}
    for label, most in ((1, toxic_rows), (0, ordinary_rows)):
        picked = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen |= {r[0]: label for r in picked.select("id").collect()}
    if not chosen:
        return ToxicityModel.fit([], [])
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    wanted = docs.sparkSession.createDataFrame([(i,) for i in chosen], f"id {source.schema['id'].dataType.simpleString()}")
    found = (
        source.where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
        .join(F.broadcast(wanted), "id", "left_semi")  # bounded by toxic_rows + ordinary_rows
        .orderBy(F.xxhash64("id", "text"))
        .limit(toxic_rows + ordinary_rows)
        .toPandas()
    )
    of = found["id"].map(chosen)
    return ToxicityModel.fit(found.loc[of == 1, "text"].tolist(), found.loc[of == 0, "text"].tolist())


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score"
) -> DataFrame:
    """``docs`` with ``score_col``, the probability that the text is toxic (replaced if it is there).

    Null and empty texts have no window and get the score of a text without any telling word. All other
    columns pass through unchanged, nulls and repeated rows included; an empty table stays empty.
    """

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(text.tolist()))

    return docs.withColumn(score_col, score(F.col(text_col)))
