"""Batch sinks: scored rows, alerts, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.profile import at_or_above


def write_scored(df: DataFrame, path: str, batch_id: int | None = None) -> str:
    """All enriched rows as JSON lines, gzipped (names fill most of a line); a batch writes, and on replay rewrites, its
    own folder."""
    target = path if batch_id is None else f"{path}/batch={batch_id}"
    df.write.mode("overwrite").json(target, compression="gzip")
    return target


def write_alerts(df: DataFrame, path: str, threshold: float, batch_id: int | None = None) -> str | None:
    """Rows at or above the threshold; no folder when there are none."""
    alerts = at_or_above(df, threshold)
    if alerts.isEmpty():
        return None
    return write_scored(alerts, path, batch_id)


def write_metrics(row: DataFrame, path: str) -> None:
    """A metrics row as one JSON object with sorted keys."""
    text = row.select(F.to_json(F.struct(*[F.col(c) for c in sorted(row.columns)])).alias("value"))
    text.limit(1).write.mode("overwrite").text(path)
