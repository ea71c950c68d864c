"""op7: token ids of every document, written as compressed blocks and read back."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm.common import table
from ledgerlens.llm.q_pieces import tokenizer_file
from ledgerlens.llm.registry import register
from ledgerlens.llm.token_blocks import read_token_blocks, write_token_blocks
from ledgerlens.session import work_dir


@register("op7_token_blocks")
def op7_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "tokens")
    tokenizer = Path(tokenizer_file("word_bpe_49k.json")).read_text(encoding="utf-8")
    write_token_blocks(table(spark, sf_dir, "documents").select("doc_id", "text"), path, tokenizer, end_id=2)
    return read_token_blocks(spark, path)
