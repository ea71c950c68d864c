"""Splitting trees over numeric vectors, grown and walked in Spark.

A tree is grown in rounds. A round looks at a bounded hash sample of every leaf that holds too many
rows, cuts it at medians into up to ``FANOUT`` parts, and moves the rows; leaves are independent, so
a round is one grouping whatever their number. Neither the splits nor the boxes reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import checkpointed

FANOUT = 256  # parts of one round: eight cuts deep
ROUNDS = 7  # node numbers stay below 2**57
SAMPLE = 16384  # expected sample rows of a leaf
ROOT = 1
SPLIT_SCHEMA = "node bigint, depth int, dims array<int>, cuts array<double>"


@dataclass
class Placed:
    """Rows with the leaf they fall in (``node``), how many rounds the tree took, and the splits of each."""

    points: DataFrame
    asked: DataFrame | None
    rounds: int
    splits: list[DataFrame]


def cut(x: np.ndarray, depth: int) -> tuple[list[int], list[float]]:
    """Dimension and cut value of each inner place, in heap order; rows at or below a cut go left.

    The dimension that varies most is cut at its median. Where all rows are equal, all go left.
    """
    dims, cuts, held = [], [], [x]
    for place in range(2**depth - 1):
        rows = held[place]
        dim, value = 0, float("inf")
        if len(rows) > 1:
            dim = int(np.argmax(rows.std(axis=0)))
            line = np.sort(rows[:, dim])
            if line[0] < line[-1]:
                value = line[(len(line) - 1) // 2]
                if value == line[-1]:  # the right side must not be empty
                    value = line[line < value][-1]
        right = rows[:, dim] > value if len(rows) else np.zeros(0, bool)
        held += [rows[~right], rows[right]]
        held[place] = None
        dims.append(dim)
        cuts.append(float(value))
    return dims, cuts


def place(points: DataFrame, asked: DataFrame, leaf_rows: int) -> Placed:
    """Grow a tree over ``points`` (id, x) until leaves hold at most ``leaf_rows`` and put both sides in it."""
    grown = grow(points, leaf_rows)
    return Placed(grown.points, walk(asked, grown.splits), grown.rounds, grown.splits)


def walk(rows: DataFrame, splits: Sequence[DataFrame]) -> DataFrame:
    """Put rows in a grown tree."""
    rows = rows.withColumn("node", F.lit(ROOT).cast("bigint"))
    for step in splits:
        rows = _moved(rows, step)
    return rows


def grow(points: DataFrame, leaf_rows: int) -> Placed:
    """Grow a tree over ``points`` (id, x) until leaves hold at most ``leaf_rows`` and put them in it."""

    def split(group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["n"].iloc[0])
        depth = int(np.clip(np.ceil(np.log2(2 * n / leaf_rows)), 1, np.log2(FANOUT)))
        dims, cuts = cut(np.stack(group["x"].to_numpy()), depth)
        return pd.DataFrame({"node": [group["node"].iloc[0]], "depth": [depth], "dims": [dims], "cuts": [cuts]})

    points, rounds = points.withColumn("node", F.lit(ROOT).cast("bigint")), []
    for round_ in range(ROUNDS):
        large = checkpointed(points.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf_rows))
        if large.isEmpty():
            break
        drawn = F.pmod(F.xxhash64("id", F.lit(round_)), F.col("n")) < SAMPLE
        sample = points.join(large, "node").where(drawn).select("node", "n", "x")
        splits = checkpointed(sample.groupBy("node").applyInPandas(split, SPLIT_SCHEMA))
        points = _moved(points, splits)
        rounds.append(splits)
    return Placed(points, None, len(rounds), rounds)


def _moved(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows of a split leaf go to the part that its cuts lead to."""
    x, dims, cuts = F.col("x"), F.col("dims"), F.col("cuts")

    def step(at: Column, _: Column) -> Column:
        right = F.get(x, F.get(dims, at)) > F.get(cuts, at)
        return 2 * at + 1 + right.cast("int")

    walked = F.aggregate(F.sequence(F.lit(1), F.col("depth")), F.lit(0), step)
    part = walked + 1 - F.pow(F.lit(2), F.col("depth")).cast("int")
    node = F.when(F.col("depth").isNull(), F.col("node")).otherwise(F.col("node") * FANOUT + part)
    return checkpointed(rows.join(splits, "node", "left").withColumn("node", node).drop("depth", "dims", "cuts"))


def boxes(rows: DataFrame, width: int, *more: Column) -> DataFrame:
    """(node, low, high): the corners of the rows of every leaf."""
    x = F.col("x")
    return rows.groupBy("node").agg(
        F.array(*[F.min(x[i]) for i in range(width)]).alias("low"),
        F.array(*[F.max(x[i]) for i in range(width)]).alias("high"),
        *more,
    )


def nodes_by_depth(leaves: DataFrame, rounds: int, width: int) -> list[DataFrame]:
    """For depth 1 to ``rounds``: (parent, node, leaf, low, high) of the nodes there, leaf or not."""
    corners = [F.array(*[f(F.col(c)[i]) for i in range(width)]).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))]
    out, below = [], None
    for depth in range(rounds, 0, -1):
        first = ROOT * FANOUT**depth
        here = leaves.where((F.col("node") >= first) & (F.col("node") < 2 * first)).withColumn("leaf", F.lit(True))
        if below is not None:
            inner = below.groupBy(F.col("parent").alias("node")).agg(*corners).withColumn("leaf", F.lit(False))
            here = here.unionByName(inner)
        below = checkpointed(here.withColumn("parent", F.floor(F.col("node") / FANOUT).cast("bigint")))
        out.append(below)
    return out[::-1]


def gap(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """Smallest possible distance between two boxes, as array functions: code of the same size at any width."""
    above = F.zip_with(low, other_high, lambda a, b: a - b)
    below = F.zip_with(other_low, high, lambda a, b: a - b)
    apart = F.zip_with(above, below, lambda a, b: F.greatest(F.lit(0.0), a, b))
    return F.sqrt(F.aggregate(apart, F.lit(0.0), lambda total, v: total + v * v))


def within_reach(seekers: DataFrame, levels: Sequence[DataFrame]) -> DataFrame:
    """(node, other, low, high): leaves of the tree whose box is within ``reach`` of a seeking leaf's box.

    ``seekers`` is (node, low, high, reach). The walk starts at the root and goes on below the nodes within reach
    only, one equi-join a depth.
    """
    ahead = seekers.select(
        F.col("node").alias("_from"), F.col("low").alias("_low"), F.col("high").alias("_high"), "reach", F.lit(ROOT).cast("bigint").alias("_at")
    )
    found = []
    for depth, level in enumerate(levels):
        if depth == 0:
            level = F.broadcast(level)  # the root has at most FANOUT children
            # Few bytes, but each row is compared with all of these.
            ahead = ahead.repartition(ahead.sparkSession.sparkContext.defaultParallelism)
        close = gap(F.col("_low"), F.col("_high"), F.col("low"), F.col("high")) <= F.col("reach") * (1 + 1e-9)
        reached = ahead.join(level, F.col("_at") == F.col("parent")).where(close)
        if depth + 1 < len(levels):
            reached = checkpointed(reached)
        found.append(reached.where("leaf").select(F.col("_from").alias("node"), F.col("node").alias("other"), "low", "high"))
        ahead = reached.where("NOT leaf").select("_from", "_low", "_high", "reach", F.col("node").alias("_at"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
