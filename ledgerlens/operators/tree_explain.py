"""Exact contributions of tree models, along tree paths, against a background.

A feature of a row being explained either keeps its value or takes that of a background row; its contribution is its
Shapley value in that game, averaged over the background. For one row, one background row and one leaf the value has a closed
form. Let U be the features on the leaf's path whose conditions the row alone meets, and V those that the background row alone
meets; if some feature's conditions are met by neither, the leaf is never reached. Otherwise each feature of U gets
``leaf (u-1)! v! / (u+v)!`` and each of V loses ``leaf u! (v-1)! / (u+v)!``.

Only the pattern of met conditions matters, so rows and background rows are reduced to their distinct patterns at each
leaf, and the work at a leaf does not grow with rows times background rows. The one-hot slots of a category are one feature.
A forest's probability and a boosted model's margin are sums over trees, so contributions add up to the row's value
minus the background's mean. Node tables travel as a broadcast of at most ``MOST_NODES`` nodes, the background is at most
``MOST_BACKGROUND`` rows; both are counted before they are collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import factorial
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.explain import CONTRIBUTION, TOP_FEATURES, _directed
from ledgerlens.session import work_dir

MOST_NODES, MOST_BACKGROUND = 4_000_000, 5_000
METHOD = "tree"


@dataclass
class Tree:
    """One node per index, the root first; ``slot`` is -1 at leaves. ``left_values`` has the categories that go left."""

    slot: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    left_values: dict[int, np.ndarray]
    classes: np.ndarray | None = None  # a forest's share of each class, (nodes, classes)

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        column = x[:, self.slot[node]]
        if node in self.left_values:
            return np.isin(column, self.left_values[node])
        return column <= self.threshold[node]


def _shares(depth: int) -> np.ndarray:
    """``(u-1)! v! / (u+v)!`` at [u, v]; that of V is the same with the two exchanged."""
    out = np.zeros((depth + 1, depth + 1))
    for u in range(1, depth + 1):
        for v in range(depth + 1 - u):
            out[u, v] = factorial(u - 1) * factorial(v) / factorial(u + v)
    return out


def tree_values(tree: Tree, owner: np.ndarray, x: np.ndarray, background: np.ndarray, out: np.ndarray) -> None:
    """Add the tree's contributions of the rows ``x`` to ``out`` (rows, features); ``owner`` has the feature of each slot."""
    both, n = np.concatenate([x, background]), len(x)
    todo: list[tuple[int, dict[int, np.ndarray]]] = [(0, {})]
    shares = None
    while todo:
        node, met = todo.pop()
        if tree.slot[node] >= 0:
            left = tree.goes_left(node, both)
            feature = int(owner[tree.slot[node]])
            for child, goes in ((tree.left[node], left), (tree.right[node], ~left)):
                todo.append((int(child), met | {feature: met[feature] & goes if feature in met else goes}))
            continue
        if not met or tree.value[node] == 0:
            continue
        features = list(met)
        width = len(features)
        if shares is None or len(shares) <= width:
            shares = _shares(max(width, 16))
        codes = np.zeros(len(both), np.int64)
        for bit, name in enumerate(features):
            codes |= met[name].astype(np.int64) << bit
        mine, back = np.unique(codes[:n], return_inverse=True)
        theirs, counts = np.unique(codes[n:], return_counts=True)
        row, column = np.nonzero((mine[:, None] | theirs[None, :]) == (1 << width) - 1)
        only_mine, only_theirs = mine[row] & ~theirs[column], theirs[column] & ~mine[row]
        u, v = np.bitwise_count(only_mine), np.bitwise_count(only_theirs)
        amount = tree.value[node] * counts[column] / len(background)
        gain, loss = amount * shares[u, v], amount * shares[v, u]
        table = np.empty((len(mine), width))
        for bit in range(width):
            part = ((only_mine >> bit) & 1) * gain - ((only_theirs >> bit) & 1) * loss
            table[:, bit] = np.bincount(row, part, minlength=len(mine))
        if table.any():
            out[:, features] += table[back]


def _trees(classifier: Any, spark) -> tuple[list[Tree], list[int]]:
    """The node tables of a fitted model, as saved, and the vector slots that they split on."""
    path = work_dir(spark, "trees")
    classifier.write().overwrite().save(path)
    table = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    size = table.count()
    if size > MOST_NODES:
        raise ValueError(f"a model of {size} nodes is beyond the {MOST_NODES} that can be explained")
    boosted = classifier.hasParam("maxIter")
    total = F.aggregate("impurityStats", F.lit(0.0), lambda a, b: a + b)
    nodes = table.select(
        "treeID",
        "id",
        F.col("split.featureIndex").alias("slot"),
        F.col("split.leftCategoriesOrThreshold").alias("at"),
        F.col("split.numCategories").alias("categories"),
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        (F.col("prediction") if boosted else F.col("impurityStats")[1] / total).alias("value"),
        *([] if boosted else [F.transform("impurityStats", lambda s: s / total).alias("classes")]),
    ).toPandas()
    nodes = nodes.sort_values(["treeID", "id"])
    used = sorted(set(nodes["slot"][nodes["left"] >= 0].tolist())) or [0]
    place = {s: i for i, s in enumerate(used)}
    weights = list(classifier.treeWeights)
    if not boosted:
        weights = [1.0 / len(weights)] * len(weights)
    trees = []
    for weight, (_, rows) in zip(weights, nodes.groupby("treeID", sort=True)):
        inner = rows["left"].to_numpy() >= 0
        order = {n: i for i, n in enumerate(rows["id"].tolist())}
        at, kinds = rows["at"].tolist(), rows["categories"].to_numpy()
        trees.append(
            Tree(
                np.array([place[s] if i else -1 for s, i in zip(rows["slot"].tolist(), inner)]),
                np.array([a[0] if i and k == -1 else np.nan for a, i, k in zip(at, inner, kinds)]),
                np.array([order.get(c, -1) for c in rows["left"].tolist()]),
                np.array([order.get(c, -1) for c in rows["right"].tolist()]),
                rows["value"].to_numpy() * weight,
                {j: np.array(a) for j, (a, i, k) in enumerate(zip(at, inner, kinds)) if i and k != -1},
                None if boosted else np.stack(rows["classes"].to_numpy()),
            )
        )
    return trees, used


@dataclass
class TreeExplainer:
    """A tree model's node tables and its background; made once, applied to any number of tables or micro-batches."""

    model: Any
    features: list[str]
    trees: list[Tree]
    used: list[int]
    owner: np.ndarray
    background: np.ndarray

    @classmethod
    def of(cls, model: Any, background: DataFrame) -> TreeExplainer:
        rows = background.count()
        if not 0 < rows <= MOST_BACKGROUND:
            raise ValueError(f"the background must have 1 to {MOST_BACKGROUND} rows, not {rows}")
        trees, used = _trees(model.classifier, background.sparkSession)
        spans = model.preprocessor.slices()
        starts = np.array([start for _, start, _ in spans])
        owner = np.searchsorted(starts, used, side="right") - 1
        made = cls(model, [name for name, _, _ in spans], trees, used, owner, np.empty((0, len(used))))
        values = made._sliced(background).select("_x").toPandas()["_x"].tolist()
        made.background = np.array(values, float).reshape(rows, len(used))
        return made

    def _sliced(self, df: DataFrame) -> DataFrame:
        ready = self.model.preprocessor.transform(df)
        cut = VectorSlicer(inputCol="features", outputCol="_cut", indices=[int(s) for s in self.used])
        return cut.transform(ready).withColumn("_x", vector_to_array("_cut"))

    def base(self) -> float:
        """The mean value of the background: a probability for forests, a margin for boosted trees."""
        total = 0.0
        for tree in self.trees:
            at = np.zeros(len(self.background), np.int64)
            while True:
                inner = np.flatnonzero(tree.slot[at] >= 0)
                if not len(inner):
                    break
                for node in np.unique(at[inner]):
                    here = inner[at[inner] == node]
                    at[here] = np.where(tree.goes_left(node, self.background[here]), tree.left[node], tree.right[node])
            total += tree.value[at].mean()
        return float(total)

    def values(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.features)))
        for tree in self.trees:
            tree_values(tree, self.owner, x, self.background, out)
        return out

    def _placed(self, df: DataFrame, top: int | None) -> Callable[[], Callable]:
        """Made once in a task: vectors to (features, values), all of them or the ``top`` largest, equal ones by name."""
        parts = ([vars(t) for t in self.trees], self.owner, self.background, len(self.features))
        by_name = np.argsort(self.features, kind="stable")
        shipped = df.sparkSession.sparkContext.broadcast(parts)

        def made() -> Callable[[pd.Series], tuple[np.ndarray, np.ndarray]]:
            plain, owner, background, width = shipped.value
            trees = [Tree(**t) for t in plain]

            def found(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
                x = np.stack(vectors.to_numpy())
                out = np.zeros((len(x), width))
                for tree in trees:
                    tree_values(tree, owner, x, background, out)
                place = np.broadcast_to(np.arange(width), out.shape)
                if top is not None:
                    size = np.abs(out[:, by_name])
                    place = by_name[np.argsort(-np.where(np.isfinite(size), size, -1.0), axis=1, kind="stable")[:, :top]]
                    out = np.take_along_axis(out, place, axis=1)
                return place, out

            return found

        return made

    def attached(self, df: DataFrame, top: int = TOP_FEATURES) -> DataFrame:
        """``df`` with the ``top`` largest contributions of each row in ``_top``, in the order of ``explain_frame``.

        They are made in the task that holds the row: nothing is grouped or joined by key.
        """
        values, count = self._placed(df, top), min(top, len(self.features))

        @F.pandas_udf("array<double>")
        def largest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            found = values()
            for batch in batches:
                yield pd.Series(list(np.hstack(found(batch))) if len(batch) else [], dtype=object)

        rows = self._sliced(df).withColumn("_best", largest("_x"))
        names = F.array(*[F.lit(f) for f in self.features])

        def entry(i: Column) -> Column:
            feature, value = F.get(names, F.get("_best", i).cast("int")), F.get("_best", i + count)
            direction = F.when(value > 0, "fraud").otherwise("legit")
            fields = (feature, feature, value, F.lit(METHOD), direction)
            return F.struct(*[f.alias(name) for name, f in zip(CONTRIBUTION, fields)])

        entries = F.transform(F.array(*[F.lit(i) for i in range(count)]), entry)
        finite = F.filter(entries, lambda e: ~F.isnan(e["value"]) & (F.abs(e["value"]) < float("inf")))
        return rows.withColumn("_top", finite).drop("features", "_cut", "_x", "_best")

    def contributions(self, df: DataFrame, key: str = "row_key", top: int | None = None) -> DataFrame:
        """One row per (key, feature) for every row of ``df``, features without influence included.

        With ``top``, a row gives its ``top`` largest only, equal ones by name: the order of ``explain_frame``.
        """
        kind = df.schema[key].dataType.simpleString()
        values = self._placed(df, top)

        def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = values()
            for batch in batches:
                if not len(batch):
                    continue
                place, out = found(batch["_x"])
                yield pd.DataFrame({key: batch[key], "_at": list(place), "value": list(out)})

        rows = self._sliced(df).select(key, "_x").mapInPandas(explain, f"`{key}` {kind}, _at array<int>, value array<double>")
        names = F.array(*[F.lit(f) for f in self.features])
        long = rows.select(key, F.inline(F.arrays_zip("_at", "value")))
        long = long.select(key, F.get(names, F.col("_at")).alias("feature"), "value")
        return _directed(long, F.col("feature"), METHOD)


def tree_contributions(model: Any, df: DataFrame, background: DataFrame, key: str = "row_key") -> DataFrame:
    """Exact contributions of a tree model's features for every row of ``df``, against the ``background`` rows."""
    return TreeExplainer.of(model, background).contributions(df, key)
