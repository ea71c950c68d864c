"""Stream sources that end in the fixed transaction schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerlens.schema import TRANSACTION_FIELDS, coerce
from ledgerlens.sources.readers import csv_missing

def landing_stream(
    spark: SparkSession,
    path: str,
    columns: list[str] | None = None,
    keep: tuple[str, ...] = (),
    max_files: int | None = None,
) -> DataFrame:
    """CSV files dropped into a folder; each is read once, as the query's checkpoint records.

    ``columns`` is the header of the files (the fixed order by default); a file with another header
    is an error instead of being read into the wrong columns. Files are taken in order of modification time,
    then path; within a micro-batch rows have no order.
    """
    names = columns or list(TRANSACTION_FIELDS)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.readStream.schema(schema).option("header", True).option("enforceSchema", False)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return coerce(csv_missing(reader.csv(path)), keep)
