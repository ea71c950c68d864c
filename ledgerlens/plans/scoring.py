"""Scoring jobs: probability, prediction, band, and reasons."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.quality import rejects
from ledgerlens.functions.scalars import risk_band
from ledgerlens.operators.explain import explain_frame
from ledgerlens.operators.history import PIPELINE_SPECS, no_history, pipeline_history
from ledgerlens.plans.feature_pipeline import FeaturePipeline
from ledgerlens.schema import SCHEMA_VERSION
from ledgerlens.session import checkpointed
from ledgerlens.sources.readers import RAW, from_records, payload_rejects

ALERT_THRESHOLD = 0.82


def score_frame(model: Any, features: DataFrame, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """Add probability, prediction and band; an absent label becomes 0."""
    p = F.col("fraud_probability")
    scored = model.transform(features).withColumns(
        {"prediction": (p >= threshold).cast("int"), "risk_band": risk_band(p, threshold)}
    )
    return scored if "isFraud" in scored.columns else scored.withColumn("isFraud", F.lit(0))


def score_batch(
    payloads: DataFrame,
    model: Any,
    pipeline: FeaturePipeline,
    threshold: float = ALERT_THRESHOLD,
    schema_version: str = SCHEMA_VERSION,
    keep: tuple[str, ...] = (),
    explain: Callable[[DataFrame], DataFrame] | None = None,
    key: str = "row_key",
) -> tuple[DataFrame, DataFrame]:
    """(scores, rejects) for a table of JSON payloads.

    Every payload is scored on its own, as its account's first transaction: no payload sees another, and
    no window or shuffle is needed. ``explain`` gives the contributions of scored rows by ``key`` (which must
    then be in ``keep``); without it the rule reasons apply. Rows that fail validation, and payloads that are
    not JSON objects, go to the rejects as they came, with their reasons.
    """
    alone = replace(pipeline, steps=[no_history if s is pipeline_history else s for s in pipeline.steps])
    rows = from_records(payloads, keep=(*keep, RAW))
    scored = score_frame(model, alone.transform(rows.drop(RAW)), threshold)
    if explain:
        scored = checkpointed(scored)  # read by the explanation and by the join with it
    enriched = explain_frame(scored, explain(scored) if explain else None, key)
    scores = enriched.select(
        *keep,
        *[s.name for s in PIPELINE_SPECS],
        "is_new_merchant",
        "fraud_probability",
        "risk_band",
        F.lit(threshold).alias("threshold"),
        "top_reasons",
        "explanation_methods",
        "feature_contributions",
        F.lit(schema_version).alias("schema_version"),
    )
    invalid = rejects(rows).select(F.col(RAW).alias("value"), "reject_reasons")
    unread = payload_rejects(payloads).select(
        F.col("value").cast("string").alias("value"), F.array(F.lit("not a JSON object")).alias("reject_reasons")
    )
    return scores, invalid.unionByName(unread)
