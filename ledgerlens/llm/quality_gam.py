"""Quality by a generalised additive model with pairwise interactions.

Every feature is cut into bins at quantiles of the training sample. Boosting goes round the features in
turn: a tree with at most four leaves on that feature alone is fitted to the current gradient, shrunk, and
added to the feature's lookup table. Then the pairs of features whose joint cells explain most of what is
left are chosen, and rounds of four-quadrant trees fill a two-way table for each. The score is the sum of
looked-up values, so scoring a batch is one bin search and one addition per table.

Fitting reads a bounded sample (``train_rows`` labelled rows, the smallest by a hash of their id): only their
numbers, one short row per document, reach the driver. Scoring reads every whole text in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import GOLDEN, Words, byte_chunks, mix

LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
#: Byte classes whose share of the text is a feature.
CLASSES = {
    "digits": b"0123456789",
    "stops": b".,;:?",
    "bangs": b"!",
    "symbols": b"#$%&*@^~+=<>\\/|_`{}[]",
    "bars": b"|",
    "line_ends": b"\n",
    "beyond_ascii": bytes(range(128, 256)),
}
FEATURES = (*CLASSES, "capitals", "log_words", "word_length", "short_words", "long_words", "repeats", "variety", "top_word")


def text_features(texts: Sequence[str | None]) -> np.ndarray:
    """One row of FEATURES per text; zeros for a null text and for what an empty text has none of."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out = np.zeros((len(texts), len(FEATURES)))
    classes = [*CLASSES.values(), bytes(range(65, 91)), LETTERS]
    for part in byte_chunks([len(t) for t in raw]):
        chunk = raw[part]
        size = np.fromiter((len(t) for t in chunk), np.int64, len(chunk))
        buffer = np.frombuffer(b"\n".join([*chunk, b""]), np.uint8)
        begins = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        counts = []
        for members in classes:
            mark = np.zeros(256, np.int32)
            mark[list(members)] = 1
            counts.append(np.add.reduceat(mark[buffer], begins))
        counts[list(CLASSES).index("line_ends")] -= 1  # the one that joins the texts
        rows = out[part]
        for k in range(len(CLASSES)):
            rows[:, k] = counts[k] / np.maximum(size, 1)
        k = len(CLASSES)
        rows[:, k] = counts[-2] / np.maximum(counts[-1], 1)
        words = Words(chunk)
        n = np.diff(words.bounds)
        if not len(words.hashes):
            continue
        owner = np.repeat(np.arange(len(chunk)), n)
        length = words.ends - words.starts
        per = lambda values: np.bincount(owner, weights=values, minlength=len(chunk)) / np.maximum(n, 1)
        again = np.zeros(len(owner))
        again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
        keys = mix(words.hashes + owner.astype(np.uint64) * GOLDEN)
        _, first, times = np.unique(keys, return_index=True, return_counts=True)
        kinds = np.bincount(owner[first], minlength=len(chunk))
        top = np.zeros(len(chunk))
        np.maximum.at(top, owner[first], times)
        rows[:, k + 1] = np.log1p(n)
        rows[:, k + 2] = per(length)
        rows[:, k + 3] = per(length <= 3)
        rows[:, k + 4] = per(length >= 12)
        rows[:, k + 5] = per(again)
        rows[:, k + 6] = kinds / np.maximum(n, 1)
        rows[:, k + 7] = top / np.maximum(n, 1)
    return out


@dataclass
class AdditiveModel:
    """Bin edges per feature, a lookup table per feature, and a two-way table per chosen pair."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    @staticmethod
    def fit(
        x: np.ndarray,
        y: np.ndarray,
        *,
        bins: int = 64,
        rounds: int = 150,
        pairs: int = 10,
        pair_rounds: int = 60,
        rate: float = 0.15,
        ridge: float = 1.0,
    ) -> AdditiveModel:
        """Cyclic boosting of the logistic loss. Without rows or with one class, a constant near the rate of 1."""
        width = x.shape[1]
        share = (y.sum() + 0.5) / (len(y) + 1)
        base = float(np.log(share / (1 - share)))
        quantiles = np.linspace(0, 1, bins + 1)[1:-1]
        edges = [np.unique(np.quantile(x[:, j], quantiles)) if len(x) else np.empty(0) for j in range(width)]
        model = AdditiveModel(edges, base, [np.zeros(len(e) + 1) for e in edges])
        if len(np.unique(y)) < 2:
            return model
        cells = model._cells(x)
        score = np.full(len(y), base)

        def sums(index: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-score))
            return (
                np.bincount(index, weights=y - p, minlength=size),
                np.bincount(index, weights=p * (1 - p), minlength=size),
            )

        for _ in range(rounds):
            for j in range(width):
                step = rate * _line_tree(*sums(cells[j], len(model.tables[j])), ridge)
                model.tables[j] += step
                score += step[cells[j]]

        gains = []
        for a in range(width):
            for b in range(a + 1, width):
                na, nb = len(model.tables[a]), len(model.tables[b])
                g, h = sums(cells[a] * nb + cells[b], na * nb)
                gains.append(((_quadrants(g.reshape(na, nb), h.reshape(na, nb), ridge)[0]), a, b))
        chosen = sorted(gains, reverse=True)[:pairs]
        model.pairs = [(a, b, np.zeros((len(model.tables[a]), len(model.tables[b])))) for _, a, b in chosen]
        for _ in range(pair_rounds):
            for a, b, grid in model.pairs:
                index = cells[a] * grid.shape[1] + cells[b]
                g, h = sums(index, grid.size)
                step = rate * _quadrants(g.reshape(grid.shape), h.reshape(grid.shape), ridge)[1]
                grid += step
                score += step.ravel()[index]
        return model

    def _cells(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        cells = self._cells(x)
        total = np.full(len(x), self.base)
        for cell, table in zip(cells, self.tables):
            total += table[cell]
        for a, b, grid in self.pairs:
            total += grid[cells[a], cells[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g, h, ridge):
    return g * g / (h + ridge)


def _line_tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 4) -> np.ndarray:
    """Leaf values per bin of the best tree on one axis: the best cut of all leaves, again and again."""
    bounds = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for lo, hi in bounds:
            if hi - lo < 2:
                continue
            cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
            left = _gain(cg[:-1], ch[:-1], ridge) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1], ridge)
            left -= _gain(cg[-1], ch[-1], ridge)
            at = int(np.argmax(left))
            if left[at] > best[0]:
                best = (left[at], (lo, hi), lo + at + 1)
        if best[1] is None:
            break
        bounds.remove(best[1])
        bounds += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for lo, hi in bounds:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """(gain, values) of the best tree with one cut on each axis of a grid."""
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    total = 0
    parts = []
    for c in (cg, ch):
        a = c[1:, 1:]
        b = c[1:, -1:] - a
        d = c[-1:, 1:] - a
        parts.append((a, b, d, c[-1, -1] - a - b - d))
    for gs, hs in zip(*parts):
        total = total + _gain(gs, np.maximum(hs, 0), ridge)
    i, j = np.unravel_index(int(np.argmax(total)), total.shape)
    values = [gs[i, j] / (max(hs[i, j], 0) + ridge) for gs, hs in zip(*parts)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(total[i, j] - _gain(cg[-1, -1], ch[-1, -1], ridge)), out


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    *,
    train_rows: int = 20_000,
) -> AdditiveModel:
    """Fit on labelled rows. Rows with a null id, text or label are left out; of repeated ids the smallest
    label counts, and each text of such an id is a row."""
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).cast("int").alias("label"))
    )
    picked = known.orderBy(F.xxhash64("id"), "id").limit(train_rows).toPandas()
    spark = docs.sparkSession
    wanted = spark.createDataFrame(picked, known.schema)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def numbers(batches):
        for batch in batches:
            found = text_features(batch["text"].tolist())
            yield pd.DataFrame({"label": batch["label"], "x": list(found)})

    found = (
        texts.join(F.broadcast(wanted), "id")  # at most train_rows ids
        .mapInPandas(numbers, "label int, x array<double>")
        .limit(2 * train_rows)
        .toPandas()
    )
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES))
    order = np.lexsort(x.T)  # the order of arrival must not matter
    return AdditiveModel.fit(x[order], found["label"].to_numpy(float)[order])


def score_quality(
    docs: DataFrame, model: AdditiveModel, text_col: str = "text", score_col: str = "score"
) -> DataFrame:
    """``docs`` with ``score_col``, the probability that the text is good (replaced if it is there).

    Null and empty texts have all features 0 and are scored as such. All other columns pass through
    unchanged, nulls and repeated rows included; an empty table stays empty.
    """

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(text_features(text.tolist())))

    return docs.withColumn(score_col, score(F.col(text_col)))
