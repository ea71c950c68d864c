"""op4: line dedup over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import table
from ledgerlens.llm.line_dedup import line_dedup
from ledgerlens.llm.registry import register

#: Lines of ``{source}`` (doc_id, text) and the text that stays; {{docs}} is the input.
LINE_CTES = """
line_rows AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM {docs}),
line_keys AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line_rows),
line_repeats AS (
  SELECT key, max(doc_id) AS last FROM line_keys WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
line_kept AS (
  SELECT k.doc_id, count(*) AS n_lines,
         count(*) FILTER (WHERE r.key IS NOT NULL AND k.doc_id <> r.last) AS n_dropped,
         coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
                  FILTER (WHERE r.key IS NULL OR k.doc_id = r.last), '') AS text
  FROM line_keys k LEFT JOIN line_repeats r ON k.key = r.key GROUP BY k.doc_id)"""


@register(
    "op4_line_dedup",
    f"WITH {LINE_CTES.format(docs='documents')}\n"
    "SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM line_kept",
)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup(docs, min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
