"""op1: toxicity of every document, learnt from part of the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import table
from ledgerlens.llm.registry import register
from ledgerlens.llm.toxicity import ToxicityModel, fit_toxicity, held_out, score_toxicity


def learnt(spark: SparkSession, sf_dir: str) -> ToxicityModel:
    """The model that learns from labels outside the held-out part, and from the full documents table."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    return fit_toxicity(table(spark, sf_dir, "documents"), labels)


@register("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, learnt(spark, sf_dir))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
