"""Row validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import label, to_number
from ledgerlens.functions.features import with_event_time

REQUIRED = ["accountNumber", "customerId", "merchantName"]


def _with_required(df: DataFrame) -> DataFrame:
    absent = [c for c in [*REQUIRED, "transactionAmount", "transactionDateTime"] if c not in df.columns]
    return df.withColumns({name: F.lit(None).cast("string") for name in absent}) if absent else df


def is_valid() -> Column:
    present = F.col("event_ts").isNotNull()
    for name in REQUIRED:
        present = present & F.col(name).isNotNull()
    return (to_number(F.col("transactionAmount")) > 0) & present


def validate(df: DataFrame) -> DataFrame:
    """Rows that can be scored: positive amount, keys present, readable time. Adds ``event_ts``."""
    return with_event_time(_with_required(df)).where(is_valid())


def rejects(df: DataFrame) -> DataFrame:
    """The complement of :func:`validate`, each row with its ``reject_reasons``."""
    df = with_event_time(_with_required(df))
    amount = to_number(F.col("transactionAmount"))
    reasons = [F.when(amount.isNull(), "amount missing").when(amount <= 0, "amount not positive")]
    reasons += [F.when(F.col(name).isNull(), f"{name} missing") for name in REQUIRED]
    reasons.append(F.when(F.col("event_ts").isNull(), "transactionDateTime unreadable"))
    tagged = df.withColumn("reject_reasons", F.array_compact(F.array(*reasons)))
    return tagged.where(F.size("reject_reasons") > 0)


def normalize_label(df: DataFrame, column: str = "isFraud") -> DataFrame:
    """0/1 labels, null as 0; an absent label column is added as 0."""
    if column not in df.columns:
        return df.withColumn(column, F.lit(0))
    return df.withColumn(column, label(F.col(column)))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, one pass over the data."""
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return row.unpivot([], row.columns, "column_name", "null_count")
