"""Batch readers: JSON lines, CSV, and JSON payload columns, all ending in the fixed schema."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.schema import coerce, raw_schema

RAW = "_raw"
JSON_SUFFIXES = {".jsonl", ".txt", ".ndjson"}

# CSV cells that count as missing.
CSV_NULLS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


def read_jsonl(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON object per line. Blank lines are skipped; a malformed line fails the job."""
    text = spark.read.schema(raw_schema(keep)).option("mode", "FAILFAST").json(path)
    return coerce(text, keep)


def read_csv(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """CSV with a header; columns are matched by name and read as text before coercion."""
    text = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    return coerce(csv_missing(text), keep)


def csv_missing(text: DataFrame) -> DataFrame:
    return text.select(
        *[F.when(~F.col(f"`{c}`").isin(CSV_NULLS), F.col(f"`{c}`")).alias(c) for c in text.columns]
    )


def read_transactions(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """By suffix: ``.jsonl``/``.txt``/``.ndjson`` are JSON lines, anything else is CSV."""
    is_json = PurePosixPath(path).suffix.lower() in JSON_SUFFIXES
    return (read_jsonl if is_json else read_csv)(spark, path, keep)


def from_records(payloads: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON payloads (an object or a list of objects per row) to the fixed schema.

    Payloads and list items that are not JSON objects are left out here; see :func:`payload_rejects`. With
    ``RAW`` in ``keep`` the text of each item is carried along.
    """
    items = payloads.select(F.explode(F.filter(_items(F.col(column)), _is_object)).alias(RAW))
    parsed = items.select(RAW, F.from_json(RAW, raw_schema(c for c in keep if c != RAW)).alias("_r"))
    return coerce(parsed.select("_r.*", *([RAW] if RAW in keep else [])), keep)


def payload_rejects(payloads: DataFrame, column: str = "value") -> DataFrame:
    """What :func:`from_records` leaves out, in ``column``: payloads without any item that could be read, and
    list items that are not JSON objects."""
    items = _items(F.col(column))
    bad = F.filter(items, lambda item: ~_is_object(item))
    whole = F.array(F.col(column).cast("string"))
    left = F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, whole).otherwise(bad)
    return payloads.withColumn(column, F.explode(left))


def _items(value: Column) -> Column:
    """The texts of the items of a JSON list, or the text itself; null for anything else."""
    text = F.ltrim(value.cast("string"))
    listed = F.transform(F.from_json(text, "array<string>"), lambda item: F.coalesce(item, F.lit("null")))
    return F.when(F.startswith(text, F.lit("[")), listed).when(F.startswith(text, F.lit("{")), F.array(text))


def _is_object(item: Column) -> Column:
    return F.startswith(F.ltrim(item), F.lit("{"))
