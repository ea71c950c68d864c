"""Isotonic regression over any number of points: adjacent violators pooled in chunks, seams in turns.

Pooling two adjacent blocks whose means fall is always right, in whatever order it is done, so chunks of the score
range can be pooled on their own. What is left are seams, where a chunk ends above the start of the next. The blocks
are then dealt into chunks again by their place in the whole, every other turn shifted by half a chunk, until no seam
falls. After the first turn a chunk has at most ``chunk`` blocks, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import label
from ledgerlens.operators.scan import chunk_count, quantile_edges, segmented_scan
from ledgerlens.session import checkpointed

CHUNK = 100_000  # points of a chunk
MODEL_BLOCKS = 200_000  # a curve of up to this many blocks becomes one model of the estimator's kind (3 MB of numbers)
BLOCKS = "part bigint, place bigint, low double, high double, ones double, n double"


def pool(low: np.ndarray, high: np.ndarray, ones: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Adjacent violators of ordered blocks pooled: the blocks whose means rise strictly."""
    at: list[list[float]] = []
    for block in zip(low.tolist(), high.tolist(), ones.tolist(), n.tolist()):
        start, end, s, w = block
        # Means are compared as products, which are exact for counts below 2^26 and close beyond.
        while at and at[-1][2] * w >= s * at[-1][3]:
            start, _, before, weight = at.pop()
            s, w = s + before, w + weight
        at.append([start, end, s, w])
    return list(np.array(at, dtype=float).reshape(-1, 4).T)


def _frame(part: int, pooled: list[np.ndarray]) -> pd.DataFrame:
    low, high, ones, n = pooled
    return pd.DataFrame({"part": np.int64(part), "place": np.arange(len(low)), "low": low, "high": high, "ones": ones, "n": n})


def _pool_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b for b in batches if len(b)]
    if parts:
        rows = pd.concat(parts)
        number = TaskContext.get().partitionId()
        yield _frame(number, pool(*[rows[c].to_numpy() for c in ("low", "high", "ones", "n")]))


def _pool_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("low")
    return _frame(int(key[0]), pool(*[rows[c].to_numpy() for c in ("low", "high", "ones", "n")]))


def falling_seams(blocks: DataFrame) -> int:
    """How many chunks end at or above the start of the next; one row a chunk is compared."""
    order = Window.orderBy("part")
    ends = blocks.groupBy("part").agg(
        F.min_by(F.struct("ones", "n"), "low").alias("first"), F.max_by(F.struct("ones", "n"), "low").alias("last")
    )
    seams = ends.withColumn("next", F.lead("first").over(order))
    return seams.where(F.expr("last.ones * next.n >= next.ones * last.n")).count()


def _dealt(blocks: DataFrame, chunk: int, shift: int) -> DataFrame:
    """``part`` anew, from the place of a block among all; the chunks' starts are one row each."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocks.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    starts = counts.select(F.col("part").alias("old"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    number = F.floor((F.col("start") + F.col("place") + shift) / chunk).cast("bigint")
    return blocks.join(starts, F.col("part") == F.col("old")).withColumn("part", number).drop("old", "start")


def isotonic_blocks(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The blocks (``low``, ``high``, ``ones``, ``n``) of the isotonic fit, means rising strictly with the score.

    ``points`` has one row per distinct score ``x``, with its rows ``n`` and those labelled 1, ``ones``; a score that is null or no number takes no part. Of two turns
    with a falling seam, one at least pools: a seam that stays on a chunk's edge is inside a chunk in the next.
    """
    if chunk < 2:
        raise ValueError("a chunk needs two blocks")
    blocks = points.select(
        F.col("x").cast("double").alias("low"),
        F.col("x").cast("double").alias("high"),
        F.col("ones").cast("double").alias("ones"),
        F.col("n").cast("double").alias("n"),
    )
    # Stored first: range edges are drawn from a sample, so the rows must not change, and a filter on a model's score
    # would be pushed below the model, which then computes it once more for each condition.
    blocks = checkpointed(blocks).where("low IS NOT NULL AND NOT isnan(low)")
    parts = max(1, -(-blocks.count() // chunk))
    ranged = blocks.repartitionByRange(parts, "low").sortWithinPartitions("low")
    blocks = checkpointed(ranged.mapInPandas(_pool_partition, BLOCKS))
    turn = 0
    while falling_seams(blocks):
        turn += 1
        shift = chunk // 2 if turn % 2 and blocks.count() > chunk else 0
        blocks = checkpointed(_dealt(blocks, chunk, shift).groupBy("part").applyInPandas(_pool_group, BLOCKS))
    return blocks.select("low", "high", "ones", "n")


def _corners(blocks: DataFrame) -> DataFrame:
    """The curve's corners: both ends of every block at its mean."""
    mean = (F.col("ones") / F.col("n")).alias("y")
    return blocks.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("x"), mean, "n")


@dataclass
class IsotonicCalibration:
    """A fitted curve: values between blocks are interpolated, those beyond the ends are the ends'."""

    score: str
    model: Any

    def transform(self, df: DataFrame, output: str = "calibrated") -> DataFrame:
        scored = self.model.transform(df.withColumn("_x", F.col(self.score).cast("double")))
        return scored.withColumn(output, F.col("_y")).drop("_x", "_y")


@dataclass
class IsotonicTable:
    """The same curve as a stored table of blocks, for more blocks than a task should hold."""

    score: str
    blocks: DataFrame

    def transform(self, df: DataFrame, output: str = "calibrated") -> DataFrame:
        """``df`` with ``output``; null where the score is null. Distinct scores meet the corners in two range scans."""
        x = F.col(self.score).cast("double")
        corners = _corners(self.blocks).select("x", F.struct("x", "y").alias("below"), F.struct((-F.col("x")).alias("x"), "y").alias("above"))
        asked = df.select(x.alias("x")).where("x IS NOT NULL").distinct()
        marks = asked.select(
            "x", *[F.lit(None).cast(corners.schema[c].dataType).alias(c) for c in ("below", "above")], F.lit(1).alias("asked")
        )
        both = checkpointed(corners.withColumn("asked", F.lit(0)).unionByName(marks))
        edges = quantile_edges(both, "x", chunk_count(both))
        left = segmented_scan(both, [], "x", maxes={"l": "below"}, edges=edges).where("asked = 1").select("x", "l")
        right = segmented_scan(both, [], "x", maxes={"r": "above"}, edges=edges, descending=True)
        right = right.where("asked = 1").select(F.col("x").alias("_rx"), "r")
        l, r, at = F.col("l.x"), -F.col("r.x"), F.col("x")
        line = F.col("l.y") + (F.col("r.y") - F.col("l.y")) * (at - l) / F.nullif(r - l, F.lit(0.0))
        value = F.when(F.col("l").isNull(), F.col("r.y")).when(F.col("r").isNull(), F.col("l.y"))
        value = value.when(l == r, F.col("l.y")).otherwise(line)
        curve = left.join(right, F.col("x") == F.col("_rx")).select(F.col("x").alias("_x"), value.alias("_y"))
        return df.join(curve, x == F.col("_x"), "left").withColumn(output, F.col("_y")).drop("_x", "_y")


def calibrate_isotonic(
    held: DataFrame, score: str = "fraud_probability", *, chunk: int = CHUNK, model_blocks: int = MODEL_BLOCKS
) -> IsotonicCalibration | IsotonicTable:
    """Monotone score map. Rows are reduced to one weighted point per distinct score, points to blocks.

    Rows without a score, or with one that is no number, take no part; a missing label counts as 0.
    """
    points = held.groupBy(F.col(score).alias("x")).agg(
        F.sum(label(F.col("isFraud"))).alias("ones"), F.count(F.lit(1)).alias("n")
    )
    blocks = isotonic_blocks(points, chunk)
    if blocks.count() > model_blocks:
        return IsotonicTable(score, blocks)
    estimator = IsotonicRegression(featuresCol="_x", labelCol="y", weightCol="n", predictionCol="_y")
    return IsotonicCalibration(score, estimator.fit(_corners(blocks).withColumnRenamed("x", "_x")))
