"""op3: quality of every document, learnt from part of the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import table
from ledgerlens.llm.quality_gam import fit_quality, score_quality
from ledgerlens.llm.registry import register
from ledgerlens.llm.toxicity import held_out


@register("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 4, 2)
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(~out))
    return score_quality(docs, model).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
