"""Joins with stored lookup tables, broadcast by measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A part up to this size is sent to all executors; a larger one is joined by an exchange, whose skewed values AQE splits.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64  # of a hashed row without its text


def part_bytes(table: DataFrame, part: str, value: str) -> dict[str, int]:
    """Estimated bytes of each part of a lookup table, counted over all its rows; one entry a part on the driver."""
    size = F.count(F.lit(1)) * ROW_BYTES + F.coalesce(F.sum(F.octet_length(F.col(value))), F.lit(0))
    return dict(table.groupBy(part).agg(size.cast("bigint")).collect())


def left_lookup(df: DataFrame, part: DataFrame, match: Column, size: int) -> DataFrame:
    """``df`` with the columns of its row in ``part``, null where there is none; ``size`` is what was measured."""
    return df.join(F.broadcast(part) if size <= BROADCAST_BYTES else part, match, "left")
