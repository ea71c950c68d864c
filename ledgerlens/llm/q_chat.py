"""op8: every conversation from every participant's perspective."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.chat_rotation import rotate
from ledgerlens.llm.common import table
from ledgerlens.llm.registry import register

SQL = r"""
WITH t AS (
  SELECT conv_id, turn, CAST(floor(turn / 256.0) AS BIGINT) AS part, coalesce(role, 'unknown') AS role,
         coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
p AS (
  SELECT t.*, s.perspective, t.role = s.perspective AS own,
         '<|im_start|>' || CASE WHEN t.role = s.perspective THEN 'assistant' WHEN t.role = 'system' THEN t.role
           ELSE 'user name=' || replace(t.role, '<|', '<\|') END || chr(10) AS head,
         replace(t.text, '<|', '<\|') || '<|im_end|>' || chr(10) AS body
  FROM t JOIN s ON t.conv_id = s.conv_id),
w AS (
  SELECT *, CAST(sum(length(head) + length(body)) OVER (
           PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, text
           ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM p)
SELECT conv_id, perspective, part, CAST(count(*) AS INTEGER) AS n_turns,
       string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
       coalesce(string_agg((stop - length(body)) || ':' || stop, ',' ORDER BY stop) FILTER (WHERE own), '') AS spans,
       CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS BIGINT) AS n_masked
FROM w GROUP BY conv_id, perspective, part"""


@register("op8_chat_rotation", SQL)
def op8_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rotate(table(spark, sf_dir, "conversations"))
    span = F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["stop"].cast("string")))
    covered = F.aggregate("mask", F.lit(0).cast("bigint"), lambda total, m: total + (m["stop"] - m["start"]))
    return rows.select(
        "conv_id", "perspective", "part", "n_turns", "rendered",
        F.array_join(span, ",").alias("spans"), covered.alias("n_masked"),
    )
