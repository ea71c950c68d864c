"""op2: near-duplicate components over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm.common import table
from ledgerlens.llm.hyperminhash import near_duplicates
from ledgerlens.llm.registry import register


@register("op2_minhash_near_dedup")
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85, bands=44, rows=7)
