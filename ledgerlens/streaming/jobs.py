"""Structured Streaming jobs: scoring, monitoring, and stateful velocity."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.functions.quality import validate
from ledgerlens.operators.explain import explain_attached, explain_frame
from ledgerlens.operators.profile import monitor_summary, tag_version
from ledgerlens.plans.feature_pipeline import DEFAULT_STEPS, LOOKBACK_COLUMNS, FeaturePipeline
from ledgerlens.plans.scoring import ALERT_THRESHOLD, score_frame
from ledgerlens.session import checkpointed
from ledgerlens.sources.sinks import write_alerts, write_scored
from ledgerlens.sources.store import FeatureStore
from ledgerlens.streaming.velocity import BUCKETS, PACKED_POINTS, VELOCITY_COLUMNS, Velocity

STATE_LATENESS = "30 days"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Declared monitoring window, slide and lateness.
MONITOR_WINDOW, MONITOR_SLIDE, WATERMARK = "5 minutes", "1 minute", "2 minutes"


def started(writer, trigger: str | None) -> StreamingQuery:
    """Start on a processing-time trigger, or drain what is available when none is given."""
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return writer.start()


def score_stream(
    stream: DataFrame,
    pipeline: FeaturePipeline,
    model: Any,
    scored_dir: str,
    alerts_dir: str,
    checkpoint: str,
    *,
    store: FeatureStore | None = None,
    history: str = "batch",
    history_days: int = 30,
    explain: Callable[[DataFrame], DataFrame] | None = None,
    attach: Callable[[DataFrame], DataFrame] | None = None,
    key: str = "row_key",
    monitor_dir: str | None = None,
    threshold: float = ALERT_THRESHOLD,
    model_version: str = "unknown",
    trigger: str | None = None,
) -> StreamingQuery:
    """Validate, featurise, store, score, explain and write each micro-batch.

    ``history="batch"`` computes windows inside the micro-batch only; ``history="store"`` also reads
    the stored rows of the batch's accounts: all of the last ``history_days``, and of older ones what
    the gap and the new-merchant flag need. Output folders and store partitions are
    named by batch id, so a replayed batch rewrites its own output. ``explain`` gives the contributions of
    scored rows by ``key``; ``attach`` adds them to the rows themselves (``TreeExplainer.attached``), without a join.
    With neither, the rule reasons apply.
    """
    if explain and attach:
        raise ValueError("give explain or attach, not both")
    if history not in ("batch", "store"):
        raise ValueError(f"history must be 'batch' or 'store', not {history!r}")

    def process(batch: DataFrame, batch_id: int) -> None:
        lookback = None
        if history == "store" and store is not None:
            # A replayed batch must not see its own earlier output.
            # Steps of the caller's own may read any stored column.
            wanted = LOOKBACK_COLUMNS if all(s in DEFAULT_STEPS for s in pipeline.steps) else None
            lookback = store.history_for(batch, history_days, exclude=f"stream-{batch_id}", wanted=wanted)
        features = checkpointed(pipeline.transform(batch, lookback))
        if features.isEmpty():
            return
        if store is not None:
            store.append(features, batch=f"stream-{batch_id}")
        scored = score_frame(model, features, threshold)
        tagged = tag_version(scored, model_version)
        if attach:
            enriched = explain_attached(attach(tagged))
        else:
            enriched = explain_frame(tagged, explain(scored) if explain else None, key)
        target = write_scored(enriched, scored_dir, batch_id)
        written = batch.sparkSession.read.schema(enriched.schema).json(target)
        write_alerts(written, alerts_dir, threshold, batch_id)
        if monitor_dir:
            write_scored(monitor_summary(written), monitor_dir, batch_id)

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return started(writer, trigger)


def monitor(scored: DataFrame) -> DataFrame:
    """Rows and mean probability per sliding window, state and band.

    On a stream, a window is emitted once the watermark has passed it and later rows are dropped.
    """
    windows = F.window("event_ts", MONITOR_WINDOW, MONITOR_SLIDE)
    return (
        scored.withWatermark("event_ts", WATERMARK)
        .groupBy(windows.alias("w"), "merchantState", "risk_band")
        .agg(F.count(F.lit(1)).alias("txn_count"), F.avg("fraud_probability").alias("avg_fraud_probability"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "merchantState",
            "risk_band",
            "txn_count",
            "avg_fraud_probability",
        )
    )


def velocity_stream(
    stream: DataFrame, key: str = "accountNumber", order: str = "row_key", packed_points: int = PACKED_POINTS
) -> DataFrame:
    """Per-account counts and sums over the rows that have arrived, as rows arrive.

    Equals the batch history when rows arrive in time order. State keeps the longest window and the allowed
    lateness, so a late row's windows are whole; rows more than ``STATE_LATENESS`` late are dropped. State is kept by
    account (see ``Velocity``) in RocksDB, which the session is set to; one micro-batch holds the new rows of a group
    of accounts.
    """
    stream.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    rows = validate(stream).withWatermark("event_ts", STATE_LATENESS).select(
        "event_ts",
        F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.col(key).cast("string").alias("account"),
        F.col(order).cast("bigint").alias("row_key"),
        F.unix_micros("event_ts").alias("us"),
        F.round(F.col("transactionAmount") * 10_000).cast("bigint").alias("units"),
    )
    return rows.groupBy("bucket").transformWithStateInPandas(Velocity(packed_points), VELOCITY_COLUMNS, "append", "eventTime")


def parquet_sink(df: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Append to Parquet files with an exactly-once commit log."""
    writer = df.writeStream.format("parquet").outputMode("append")
    return started(writer.option("path", path).option("checkpointLocation", checkpoint), trigger)
