"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet below
``spark.checkpoint.dir`` and reads it back as the next stage's documents. All stages but the last return the
columns of ``documents``.

1. toxicity: documents scored 0.5 or more go. The model learns from the labels of the table ``labels``.
2. line_dedup: repeated lines go; documents stay, with what is left of their text and ``n_chars`` to match.
3. near_dedup: of each near-duplicate component the document with the smallest id stays. Rows are told apart by id and
   text, so a unique text stays though its id has a copy as well.
4. decontaminate: documents that share a passage with the table ``benchmark`` go.
5. pieces: every document gets its SentencePiece ids; nothing goes.

Documents without an id stay in near_dedup, which decides by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import checkpointed, fresh, small_batches, table
from ledgerlens.llm.hyperminhash import near_duplicates
from ledgerlens.llm.line_dedup import line_dedup
from ledgerlens.llm.piece_transducer import encode_pieces
from ledgerlens.llm.q_pieces import machine
from ledgerlens.llm.spaced_seeds import overlaps
from ledgerlens.llm.toxicity import fit_toxicity, score_toxicity

# Word paths a worker keeps in pieces, about 36 MB: the stages before leave less memory than the operator alone has.
REMEMBERED = 200_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return score_toxicity(docs, model, score_col=score).where(F.col(score) < 0.5).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # The other columns pass in a struct: one may be named as a count of the operator.
    kept = line_dedup(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("rest")))
    out = {c: F.col("rest")[c].alias(c) for c in rest}
    if "n_chars" in rest:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out["n_chars"] = F.when(F.col("n_dropped") > 0, length).otherwise(F.col("rest")["n_chars"]).alias("n_chars")
    return kept.select(*[out.get(c, F.col(c)) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    copies = near_duplicates(docs, signed=True).where(~F.col("kept") & F.col("doc_id").isNotNull())
    return without(docs, copies.select("doc_id", "sign"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return without(docs, overlaps(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "sign"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the rows in ``gone`` (id, xxhash64 of the text): rows without an id can go too, and of rows that
    share an id only those with the text."""
    key, sign = fresh(docs, "gone_id"), fresh(docs, "gone_sign")
    gone = checkpointed(gone.distinct().toDF(key, sign))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(sign)), "left_anti")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return encode_pieces(docs, machine(), remembered=REMEMBERED)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pieces", pieces),
]

#: SQL cannot express the toxicity model; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return docs
