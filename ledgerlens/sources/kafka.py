"""Kafka topic in and out. The connector package must be on the cluster's classpath."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.readers import from_records


def kafka_options(
    servers: str, topic: str, starting_offsets: str = "latest", max_offsets: int = 5000
) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
        "maxOffsetsPerTrigger": str(max_offsets),
    }


def read_topic(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """The topic as a stream of coerced transactions; offsets live in the query's checkpoint."""
    stream = spark.readStream.format("kafka").options(**kafka_options(servers, topic, **options)).load()
    return decode(stream)


def decode(messages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Message values (bytes) to transactions."""
    return from_records(messages.select(F.col("value").cast("string").alias("value")), keep=keep)


def encode(df: DataFrame, key: str = "accountNumber") -> DataFrame:
    """Rows to messages: JSON value, account key (keeps an account's order in one partition)."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def publish(df: DataFrame, servers: str, topic: str, n: int | None = None, order: str = "row_key") -> None:
    """Write the first ``n`` rows (all when None) to a topic."""
    rows = df if n is None else df.orderBy(order).limit(n)
    encode(rows).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
