"""op13: runs of every document, some of which are made periodic first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import table
from ledgerlens.llm.periodic_runs import periodic_runs
from ledgerlens.llm.registry import register

BLANKS = r"[\x20\x09-\x0D]+"


def made_periodic(docs: DataFrame) -> DataFrame:
    """Words of a tenth of the documents, by a hash of the id, replaced so that one period repeats to the end."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), BLANKS, -1), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("words").cast("bigint"), F.floor(F.col("h") / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))

    def other(i: Column) -> Column:
        return F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))

    # The places are computed once per row, not once per word.
    chosen = chosen.withColumns({"n": n, "a": F.when(n > 0, a), "p": F.when(n > 0, p)})
    edited = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), other), " ")
    return chosen.select("doc_id", F.when(F.col("a").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


@register("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(made_periodic(table(spark, sf_dir, "documents")))

    def stronger(best: Column, run: Column) -> Column:
        mine, held = run["length"] * best["period"], best["length"] * run["period"]  # exact: no division
        return F.when(best.isNull() | (mine > held), run).otherwise(best)

    # Runs come by start, then period, so the first of equal exponents is kept.
    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    top = F.aggregate("runs", nothing, stronger)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        top.alias("top"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        "top.start",
        "top.length",
        "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
