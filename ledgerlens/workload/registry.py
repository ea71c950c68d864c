"""Registered queries: a Spark callable and, where one exists, the SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.functions.quality import validate
from ledgerlens.schema import coerce
from ledgerlens.workload.fixture import TXN_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VALID_CTE = """valid AS (
  SELECT *, TRY_CAST(transactionDateTime AS TIMESTAMP) AS ets,
         epoch_us(TRY_CAST(transactionDateTime AS TIMESTAMP)) AS us,
         CASE WHEN isFraud THEN 1 ELSE 0 END AS y,
         ((row_key * 7919) % 1000) / CAST(1000 AS DOUBLE) AS p
  FROM txn
  WHERE transactionAmount > 0 AND accountNumber IS NOT NULL AND customerId IS NOT NULL
    AND merchantName IS NOT NULL AND TRY_CAST(transactionDateTime AS TIMESTAMP) IS NOT NULL)"""


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register under ``name``. ``oracle`` may start with further CTEs after ``txn`` and ``valid``."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            body = oracle.strip()
            more = body[4:].lstrip() if body.upper().startswith("WITH") else None
            head = f"WITH txn AS ({TXN_SQL}),\n{VALID_CTE}"
            ORACLES[name] = f"{head},\n{more}" if more else f"{head}\n{body}"
        return fn

    return add


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transaction view over the ``events`` table, all rows."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(TXN_SQL.replace("FROM events", "FROM {events}"), events=events)


def coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coerce(raw(spark, sf_dir), keep=("row_key",))


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(coerced(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows with a deterministic score column, so metric queries need no model."""
    from pyspark.sql import functions as F

    return valid(spark, sf_dir).withColumns(
        {
            "isFraud": F.coalesce(F.col("isFraud").cast("int"), F.lit(0)),
            "fraud_probability": F.pmod(F.col("row_key") * 7919, F.lit(1000)) / F.lit(1000.0),
        }
    )


EPSILON = 1e-9


def rounded_sql(expression: str, digits: int) -> str:
    """Rounding that ends ties the same way in both engines."""
    return f"round({expression} + {EPSILON}, {digits})"


def rounded(column, digits: int):
    from pyspark.sql import functions as F

    column = F.col(column) if isinstance(column, str) else column
    return F.round(column + F.lit(EPSILON), digits)
