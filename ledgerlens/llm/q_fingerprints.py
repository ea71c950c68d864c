"""op11: prints of every document and of its text with a changed tail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm.common import table
from ledgerlens.llm.registry import register
from ledgerlens.llm.winnowing import successor_fingerprints


@register("op11_fingerprints")
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return successor_fingerprints(table(spark, sf_dir, "documents"))
