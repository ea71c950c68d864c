"""Entity fraud-rate encoders and class weights."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import label
from ledgerlens.operators.lookup import left_lookup, part_bytes
from ledgerlens.schema import ENCODED_ENTITIES
from ledgerlens.session import checkpointed


@dataclass(frozen=True)
class Encoders:
    """Fitted rates: a stored table (entity, value, frauds, rows, rate) and the overall counts."""

    rates: DataFrame
    frauds: int
    rows: int

    @cached_property
    def sizes(self) -> dict[str, int]:
        """Bytes of each entity's rates."""
        return part_bytes(self.rates, "entity", "value")

    @property
    def global_rate(self) -> float:
        return self.frauds / self.rows if self.rows else 0.0

    @property
    def fraud_weight(self) -> float:
        """Largest class count over fraud count; 1.0 without fraud."""
        return max(self.frauds, self.rows - self.frauds) / self.frauds if self.frauds else 1.0


def encoder_partials(
    df: DataFrame, entities: Sequence[str] = ENCODED_ENTITIES, target: str = "isFraud"
) -> DataFrame:
    """Label sums and row counts per (entity, value); mergeable."""
    long = df.select(
        label(F.col(target)).cast("bigint").alias("_y"), *[F.col(c).cast("string") for c in entities]
    ).unpivot(["_y"], list(entities), "entity", "value")
    return long.groupBy("entity", "value").agg(
        F.sum("_y").alias("frauds"), F.count(F.lit(1)).alias("rows")
    )


def merge_partials(*partials: DataFrame) -> DataFrame:
    """Rates from partial tables of separate chunks."""
    merged = partials[0]
    for part in partials[1:]:
        merged = merged.unionByName(part)
    return (
        merged.groupBy("entity", "value")
        .agg(F.sum("frauds").alias("frauds"), F.sum("rows").alias("rows"))
        .withColumn("rate", F.col("frauds") / F.col("rows"))
    )


def encoder_fit(
    df: DataFrame, entities: Sequence[str] = ENCODED_ENTITIES, target: str = "isFraud"
) -> Encoders:
    """Mean label per value of each entity column, null kept as a value, and overall.

    One pass over the rows. The rates are checkpointed, so applying them does not read the training
    rows again.
    """
    rates = checkpointed(
        encoder_partials(df, entities, target).withColumn("rate", F.col("frauds") / F.col("rows"))
    )
    frauds, rows = (
        rates.where(F.col("entity") == entities[0]).agg(F.sum("frauds"), F.sum("rows")).first()
    )
    return Encoders(rates, int(frauds or 0), int(rows or 0))


def encoder_apply(
    df: DataFrame, encoders: Encoders, entities: Sequence[str] = ENCODED_ENTITIES
) -> DataFrame:
    """``{entity}_fraud_rate``: the fitted rate of the value, else the global rate.

    The rates of an entity with few values are broadcast by their measured size, so rows are never shuffled on such a
    column; the others are joined by an exchange, whose skewed values AQE splits.
    """
    default = F.lit(encoders.global_rate)
    for entity in entities:
        rates = encoders.rates.where(F.col("entity") == entity).select(
            F.col("value").alias("_value"), F.col("rate").alias("_rate")
        )
        df = (
            left_lookup(df, rates, F.col(entity).cast("string") == F.col("_value"), encoders.sizes.get(entity, 0))
            .withColumn(f"{entity}_fraud_rate", F.coalesce(F.col("_rate"), default))
            .drop("_value", "_rate")
        )
    return df


def class_weights(df: DataFrame, target: str = "isFraud") -> DataFrame:
    """``class_weight``: largest class count over fraud count on fraud rows, 1.0 elsewhere."""
    y = label(F.col(target)).cast("bigint")
    counts = df.agg(F.struct(F.sum(y).alias("fraud"), F.sum(1 - y).alias("legit"))).scalar()
    fraud, legit = counts.getField("fraud"), counts.getField("legit")
    weight = F.greatest(fraud, legit) / F.nullif(fraud.cast("double"), F.lit(0.0))
    return df.withColumns(
        {
            target: label(F.col(target)),
            "class_weight": F.when(y == 1, F.coalesce(weight, F.lit(1.0))).otherwise(F.lit(1.0)),
        }
    )


def scale_pos_weight(df: DataFrame, target: str = "isFraud") -> DataFrame:
    y = label(F.col(target))
    return df.agg(
        F.count_if(y == 0).alias("legit"),
        F.count_if(y == 1).alias("fraud"),
        (F.count_if(y == 0) / F.nullif(F.count_if(y == 1).cast("double"), F.lit(0.0))).alias(
            "scale_pos_weight"
        ),
    )
