"""Exact k-nearest-neighbour join on numeric vectors.

Identical data vectors are reduced to the few copies that can matter, so a large group of copies
costs no more than one row. Points fall into the leaves of a splitting tree, which hold a bounded
number of rows at any table size. Every query looks through its own leaf first; then it goes to those
leaves whose bounding box is no further away than its k-th distance so far, which cannot lose a
neighbour. Missing, not-a-number and infinite components count as 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.kdtree import boxes, gap, grow, nodes_by_depth, walk, within_reach
from ledgerlens.session import checkpointed

BLOCK_ROWS = 4000  # data rows of a leaf
QUERY_ROWS = 4000  # queries that meet one copy of a leaf
STEP = 500  # queries per distance matrix inside a block
PAIR_SCHEMA = "qid bigint, id bigint, distance double"


def vectors(df: DataFrame, columns: Sequence[str], key: str = "row_key") -> DataFrame:
    """(id, x): the numeric columns of each row as one array; missing and non-finite values are 0."""
    numbers = [F.col(c).cast("double") for c in columns]
    values = [F.when(F.abs(v) < float("inf"), v).otherwise(F.lit(0.0)) for v in numbers]
    return df.select(F.col(key).cast("bigint").alias("id"), F.array(*values).alias("x"))


def nearest(queries: DataFrame, data: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, neighbor, distance, rank): the k nearest data rows of every query row, itself excluded.

    Both sides are (id, x) tables; equal distances are ordered by id.
    """
    return Index.of(data, k, block_rows).nearest(queries)


def hashed(rows: DataFrame) -> DataFrame:
    """Rows with a hash of ``x`` to sort by before ``x``: long vectors are then seldom compared."""
    return rows.withColumn("_h", F.xxhash64("x"))


@dataclass
class Index:
    """Data rows in the leaves of a tree, for several searches of ``k`` neighbours."""

    k: int
    width: int
    points: DataFrame
    splits: list[DataFrame]

    @classmethod
    def of(cls, data: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> Index:
        need = k + 1  # a query row may find itself
        copies = Window.partitionBy("_h", "x").orderBy("id")
        numbered = hashed(data).withColumn("_n", F.row_number().over(copies))
        points = checkpointed(numbered.where(F.col("_n") <= need).select("id", "x"))
        head = points.select(F.size("x").alias("n")).first()
        if head is None:
            return cls(k, 0, points, [])
        grown = grow(points, max(block_rows, 4 * need))
        return cls(k, head.n, grown.points, grown.splits)

    @cached_property
    def levels(self) -> list[DataFrame]:
        return nodes_by_depth(boxes(self.points, self.width), len(self.splits), self.width)

    def nearest(self, queries: DataFrame) -> DataFrame:
        queries = hashed(queries)
        asked = checkpointed(queries.groupBy("_h", "x").agg(F.min("id").alias("qid")).select("qid", "x", "_h"))
        best = self._search(asked.select("qid", "x"))

        found = queries.join(asked, ["_h", "x"]).select("id", "qid").join(best.withColumnRenamed("id", "neighbor"), "qid")
        closest = Window.partitionBy("id").orderBy("distance", "neighbor")
        return (
            found.where(F.col("neighbor") != F.col("id"))
            .withColumn("rank", F.row_number().over(closest))
            .where(F.col("rank") <= self.k)
            .select("id", "neighbor", "distance", "rank")
        )

    def _search(self, asked: DataFrame) -> DataFrame:
        need = self.k + 1
        if not self.width:
            return asked.sparkSession.createDataFrame([], PAIR_SCHEMA)
        asked = walk(asked, self.splits)

        # First look: each query against its own leaf. Its worst distance there bounds what can still be nearer.
        first = _match(asked, self.points, need)
        if not self.splits:
            return first
        first = checkpointed(first)
        seen = first.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
        reach = F.when(F.col("n") >= need, F.col("far")).otherwise(F.lit(float("inf")))
        bounded = checkpointed(asked.join(seen, "qid", "left").select("qid", "x", "node", reach.alias("reach")))

        seekers = boxes(bounded, self.width, F.max("reach").alias("reach"))
        pairs = within_reach(seekers, self.levels).where(F.col("node") != F.col("other"))
        near = gap(F.col("x"), F.col("x"), F.col("low"), F.col("high")) <= F.col("reach") * (1 + 1e-9)
        further = checkpointed(bounded.join(pairs, "node").where(near).select("qid", "x", F.col("other").alias("node")))
        closest = Window.partitionBy("qid").orderBy("distance", "id")
        return (
            first.unionByName(_match(further, self.points, need))
            .withColumn("_n", F.row_number().over(closest))
            .where(F.col("_n") <= need)
            .drop("_n")
        )


def _match(asked: DataFrame, points: DataFrame, need: int) -> DataFrame:
    """Best ``need`` points of the leaf ``node`` for every query sent there.

    A leaf's queries are dealt out to parts of about ``QUERY_ROWS``, each with a copy of the leaf.
    """
    parts = F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("parts")
    wanted = checkpointed(asked.groupBy("node").agg(parts))
    left = asked.join(wanted, "node").select(
        "node", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int").alias("part"), F.col("qid").alias("id"), "x"
    )
    right = points.join(wanted, "node").select(
        "node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "x"
    )

    def block(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        return best_of(q, d.sort_values("id"), need)

    return left.groupBy("node", "part").cogroup(right.groupBy("node", "part")).applyInPandas(block, PAIR_SCHEMA)


def best_of(q: pd.DataFrame, d: pd.DataFrame, need: int) -> pd.DataFrame:
    """Brute force of queries against one leaf; ``d`` is sorted by id, so ties go to the smaller id.

    A matrix product gives all distances but for its rounding; only rows that this rounding leaves in question for the
    best ``need`` get their distance summed column by column.
    """
    empty = pd.DataFrame({"qid": [], "id": [], "distance": []}).astype({"qid": "int64", "id": "int64"})
    if q.empty or d.empty:
        return empty
    data, ids = np.stack(d["x"].to_numpy()), d["id"].to_numpy()
    take, out = min(need, len(ids)), []
    middle = data.mean(axis=0)
    for start in range(0, len(q), STEP):
        part = q.iloc[start : start + STEP]
        asked = np.stack(part["x"].to_numpy())
        row, column = np.nonzero(_in_question(asked - middle, data - middle, take))
        distance = np.zeros(len(row))
        for j in range(data.shape[1]):
            distance += (asked[row, j] - data[column, j]) ** 2
        distance = np.sqrt(distance)
        order = np.lexsort((column, distance, row))
        # Each query has at least ``take`` rows here.
        first = np.searchsorted(row, np.arange(len(part)))
        best = order[(first[:, None] + np.arange(take)).ravel()]
        out.append(
            pd.DataFrame(
                {"qid": np.repeat(part["id"].to_numpy(), take), "id": ids[column[best]], "distance": distance[best]}
            )
        )
    return pd.concat(out, ignore_index=True)


def _in_question(asked: np.ndarray, data: np.ndarray, take: int) -> np.ndarray:
    """(queries, rows): whether the row can be among the query's ``take`` nearest, for all that rounding may do."""
    with np.errstate(over="ignore", invalid="ignore"):
        mine, theirs = (asked * asked).sum(axis=1), (data * data).sum(axis=1)
        size = mine[:, None] + theirs.max()
        about = mine[:, None] + theirs - 2 * (asked @ data.T)
    if not np.isfinite(size).all():
        return np.ones(about.shape, bool)
    limit = np.partition(about, take - 1, axis=1)[:, take - 1 : take]
    # The product's error is below (columns + 4) * 2**-52 * 2 * size, that of the exact sum far less.
    return about <= limit + 4 * (data.shape[1] + 8) * 2.0**-52 * 2 * size
