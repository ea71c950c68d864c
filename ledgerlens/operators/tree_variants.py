"""Scores of a tree model for rows with some features taken from background rows.

The rows and the background are preprocessed once; a swapped feature replaces its slots in the row's vector, and the
variants are scored in arrays next to the row, so that they are neither joined nor shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.tree_explain import MOST_BACKGROUND, MOST_NODES, Tree, TreeExplainer

STEP = 1000  # rows whose variants are held at once


def leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf that each row of ``x`` reaches."""
    at, kinds = np.zeros(len(x), np.int64), None
    if tree.left_values:
        kinds = np.zeros((len(tree.slot), 1 + int(max(v.max(initial=0) for v in tree.left_values.values()))), bool)
        for node, values in tree.left_values.items():
            kinds[node, values.astype(int)] = True
        listed = np.zeros(len(tree.slot), bool)
        listed[list(tree.left_values)] = True
    while True:
        here = np.flatnonzero(tree.slot[at] >= 0)
        if not len(here):
            return at
        nodes = at[here]
        column = x[here, tree.slot[nodes]]
        left = column <= tree.threshold[nodes]
        if kinds is not None:
            named = np.flatnonzero(listed[nodes])
            value = column[named]
            known = (value >= 0) & (value < kinds.shape[1]) & (value == np.floor(value))
            left[named] = known & kinds[nodes[named], np.where(known, value, 0).astype(int)]
        at[here] = np.where(left, tree.left[nodes], tree.right[nodes])


def probability(trees: Sequence[Tree], reached: Sequence[np.ndarray]) -> np.ndarray:
    """The model's probability from the leaf reached in each tree, summed as the model does."""
    if trees[0].classes is None:
        return 1.0 - 1.0 / (1.0 + np.exp(2.0 * sum(t.value[at] for t, at in zip(trees, reached))))
    votes = sum(t.classes[at] for t, at in zip(trees, reached))
    return votes[:, 1] / votes.sum(axis=1)


def swapped_means(
    trees: Sequence[Tree], owner: np.ndarray, features: Sequence[int], x: np.ndarray, background: np.ndarray
) -> np.ndarray:
    """(rows, features): the mean probability with one feature taken from each background row."""
    own = [leaves(t, x) for t in trees]
    unmoved = _mean(probability(trees, own)[None, :], np.zeros(len(background), int))
    out = np.repeat(unmoved[:, None], len(features), axis=1)
    for place, feature in enumerate(features):
        slots = np.flatnonzero(owner == feature)
        users = [i for i, t in enumerate(trees) if np.isin(t.slot, slots).any()]
        if not users:
            continue
        # Background rows on the same side of every condition on the feature give the same scores.
        sides = [
            trees[i].goes_left(node, background) for i in users for node in np.flatnonzero(np.isin(trees[i].slot, slots))
        ]
        _, first, which = np.unique(np.stack(sides, axis=1), axis=0, return_index=True, return_inverse=True)
        scores = np.empty((len(first), len(x)))
        moved = x.copy()
        for j, row in enumerate(first):
            moved[:, slots] = background[row, slots]
            scores[j] = probability(trees, [leaves(t, moved) if i in users else own[i] for i, t in enumerate(trees)])
        out[:, place] = _mean(scores, which.ravel())
    return out


def _mean(scores: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Mean of ``scores[which]``, added one by one in that order."""
    total = np.zeros(scores.shape[1])
    for j in which:
        total += scores[j]
    return total / len(which)


@dataclass
class TreeVariants:
    """A tree model, the features that may be swapped (places in the model's list) and the background."""

    explainer: TreeExplainer
    names: list[str]
    swapped: list[int]

    @classmethod
    def of(cls, model: Any, background: DataFrame, features: Sequence[str]) -> TreeVariants | None:
        """None for other models, and for trees or backgrounds too large to be sent to every task."""
        classifier = model.classifier
        if not hasattr(classifier, "treeWeights") or classifier.totalNumNodes > MOST_NODES:
            return None
        if not 0 < background.limit(MOST_BACKGROUND + 1).count() <= MOST_BACKGROUND:
            return None
        p = model.preprocessor
        kinds = {**dict.fromkeys(p.categorical, "string"), **dict.fromkeys(p.numeric, "double")}
        known = [F.col(c) if c in features else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()]
        explainer = TreeExplainer.of(model, background.select(*known))
        return cls(explainer, list(features), [explainer.features.index(f) for f in features])

    def vectors(self, df: DataFrame, *columns: str) -> DataFrame:
        """``columns`` and ``_x``, the slots that the trees split on."""
        return self.explainer._sliced(df).select(*columns, "_x")

    def _shipped(self, df: DataFrame):
        e = self.explainer
        return df.sparkSession.sparkContext.broadcast(([vars(t) for t in e.trees], e.owner, e.background))

    def means(self, df: DataFrame, key: str, base: str) -> DataFrame:
        """(key, base, feature, mean): one row per row of ``df`` and feature."""
        shipped, swapped = self._shipped(df), list(self.swapped)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            plain, owner, background = shipped.value
            trees = [Tree(**t) for t in plain]
            for batch in batches:
                for start in range(0, batch.num_rows, STEP):
                    part = batch.slice(start, STEP)
                    x = np.stack(part.column("_x").to_numpy(zero_copy_only=False))
                    means = pa.array(list(swapped_means(trees, owner, swapped, x, background)), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), means], [key, base, "_means"])

        kinds = dict(df.dtypes)
        rows = self.vectors(df, key, base).mapInArrow(score, f"`{key}` {kinds[key]}, `{base}` {kinds[base]}, _means array<double>")
        names = F.array(*[F.lit(n) for n in self.names])
        long = rows.select(key, base, F.posexplode("_means").alias("_at", "mean"))
        return long.select(key, base, F.get(names, F.col("_at")).alias("feature"), "mean")

    def perturbed(self, copies: DataFrame, key: str, samples: int, fit: Any) -> DataFrame:
        """(key, feature, value) from ``fit(z, score)`` of each key's perturbed copies.

        ``copies`` is (key, _i, _rows, _pick, _z0, ...): the copies of a key follow each other from ``_i`` 0 on, the
        first one has the key's vectors in ``_rows``; ``_pick`` is the background row and the bits of ``_z0``, ...
        tell which features come from it, 62 in each.
        """
        shipped, swapped, names = self._shipped(copies), list(self.swapped), np.array(self.names)

        def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            plain, owner, background = shipped.value
            trees = [Tree(**t) for t in plain]
            place = {f: i for i, f in enumerate(swapped)}
            bit_of_slot = np.array([place.get(int(f), -1) for f in owner])
            held: list[pa.RecordBatch] = []
            waiting = 0

            def done(table: pa.Table) -> pa.RecordBatch:
                first = np.arange(0, table.num_rows, samples)
                bits = [table.column(f"_z{j}").to_numpy() for j in range(-(-len(swapped) // 62))]
                z = np.stack([(bits[i // 62] >> (i % 62)) & 1 for i in range(len(swapped))], axis=1).astype(bool)
                other = background[table.column("_pick").to_numpy()]
                heads = table.take(pa.array(first))
                taken = np.where(bit_of_slot >= 0, z[:, bit_of_slot], False)
                listed = heads.column("_rows").to_pylist()
                moved = np.repeat(np.array([row for rows in listed for row in rows], float), samples, axis=0)
                at = np.concatenate([np.arange(start, start + samples) for start, rows in zip(first, listed) for _ in rows])
                moved = np.where(taken[at], other[at], moved)
                score, here = probability(trees, [leaves(t, moved) for t in trees]), 0
                whose, features, values = [], [], []
                for group, (start, rows) in enumerate(zip(first, listed)):
                    size = samples * len(rows)
                    mine = np.tile(z[start : start + samples].astype(int), (len(rows), 1))
                    places, weights = fit(mine, score[here : here + size])
                    here += size
                    whose += [group] * len(places)
                    features += names[places].tolist()
                    values += weights.tolist()
                keys = heads.column(key).take(pa.array(whose, pa.int64())).combine_chunks()
                return pa.RecordBatch.from_arrays([keys, pa.array(features, pa.string()), pa.array(values, pa.float64())], [key, "feature", "value"])

            for batch in batches:
                held.append(batch)
                waiting += batch.num_rows
                whole = waiting - waiting % samples
                if whole:
                    table = pa.Table.from_batches(held)
                    held = table.slice(whole).to_batches()
                    waiting -= whole
                    yield done(table.slice(0, whole).combine_chunks())

        kind = dict(copies.dtypes)[key]
        return copies.mapInArrow(explain, f"`{key}` {kind}, feature string, value double")
