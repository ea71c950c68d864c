"""Isolation forest: trees grown in parallel on small samples, scored with a vectorised UDF."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.split import hash_sample
from ledgerlens.session import checkpointed

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, length double"
EULER = 0.5772156649015329


def expected_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def grow(points: np.ndarray, tree: int, seed: int) -> list[tuple]:
    """One random tree as node rows; leaves carry their expected path length."""
    rng = np.random.default_rng([seed, tree])
    limit = int(np.ceil(np.log2(max(2, len(points)))))
    nodes: list[list] = []

    def build(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([tree, at, -1, 0.0, -1, -1, depth + expected_path(len(rows))])
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (0, 0)
        usable = np.flatnonzero(high > low) if len(rows) > 1 and depth < limit else []
        if len(usable):
            f = int(rng.choice(usable))
            cut = float(rng.uniform(low[f], high[f]))
            below = rows[:, f] < cut
            nodes[at][2:4] = [f, cut]
            nodes[at][4] = build(rows[below], depth + 1)
            nodes[at][5] = build(rows[~below], depth + 1)
        return at

    build(points, 0)
    return [tuple(n) for n in nodes]


@dataclass
class IsolationForest:
    columns: list[str]
    nodes: pd.DataFrame
    sample_rows: int
    spark: object

    def score(self) -> Column:
        """Anomaly score in (0, 1); higher is more unusual."""
        trees = [
            tuple(g.sort_values("node")[c].to_numpy() for c in ("feature", "threshold", "left", "right", "length"))
            for _, g in self.nodes.groupby("tree")
        ]
        shared = self.spark.sparkContext.broadcast(trees)  # trees × at most 2·256 nodes
        norm = expected_path(self.sample_rows)

        @F.pandas_udf("double")
        def anomaly(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(path_score(np.stack(batch.to_numpy()), shared.value, norm))

        inputs = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.columns]
        return anomaly(F.array(*inputs))

    def transform(self, df: DataFrame, name: str = "iso_score") -> DataFrame:
        return df.withColumn(name, self.score())


def path_score(x: np.ndarray, trees: Sequence[tuple], norm: float) -> np.ndarray:
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, threshold, left, right, length in trees:
        at = np.zeros(len(x), dtype=int)
        while True:
            split = feature[at] >= 0
            if not split.any():
                break
            f = np.where(split, feature[at], 0)
            step = np.where(x[rows, f] < threshold[at], left[at], right[at])
            at = np.where(split, step, at)
        total += length[at]
    mean = total / max(1, len(trees))
    return np.power(2.0, -mean / norm) if norm > 0 else np.full(len(x), 0.5)


def fit_isolation_forest(
    df: DataFrame,
    columns: Sequence[str],
    trees: int = 100,
    sample_rows: int = 256,
    seed: int = 42,
    key: str = "row_key",
) -> IsolationForest:
    """Each tree sees about ``sample_rows`` rows of a pool of at most ``trees × sample_rows`` rows.

    A row of a full pool is in one tree, chosen by its hash; rows of a smaller pool are in as many trees as
    it takes, all different. So about ``trees × sample_rows`` rows are dealt out in either case.
    """
    columns = list(columns)
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    pool = checkpointed(hash_sample(df.select(key, F.array(*values).alias("x")), trees * sample_rows, key, seed))
    rows = pool.count()
    copies = min(trees, max(1, -(-trees * sample_rows // max(1, rows))))
    start = F.xxhash64(key, F.lit(seed))
    samples = pool.select(key, "x", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_copy")).select(
        "x",
        F.pmod(F.pmod(start, F.lit(trees)) + F.col("_copy"), F.lit(trees)).cast("int").alias("tree"),
        F.xxhash64(key, "_copy", F.lit(seed)).alias("_n"),
    )

    def grow_tree(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_n")
        tree = int(group["tree"].iloc[0])
        nodes = grow(np.stack(group["x"].to_numpy()), tree, seed)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "length"])

    nodes = samples.groupBy("tree").applyInPandas(grow_tree, NODE_SCHEMA).toPandas()
    size = int(min(sample_rows, rows))
    return IsolationForest(columns, nodes, size, df.sparkSession)
