"""op10: SentencePiece ids of every document, decoded again."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm.common import table
from ledgerlens.llm.piece_transducer import PieceTransducer, encode_pieces
from ledgerlens.llm.registry import register


def tokenizer_file(name: str) -> str:
    """The public tokenizer file ``name``: below LEDGERLENS_TOKENIZERS if that is set, else where its package has it."""
    folder = os.environ.get("LEDGERLENS_TOKENIZERS")
    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


def machine() -> PieceTransducer:
    return PieceTransducer(str(tokenizer_file("piece_bpe_32k.model")))


@register("op10_sentencepiece")
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_pieces(docs, machine()).select("doc_id", "n_ids", "ids", "round_trip")
