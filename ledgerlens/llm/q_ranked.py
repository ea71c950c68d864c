"""op12: the ten best documents for each benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm.best_position import ranked_search
from ledgerlens.llm.common import table
from ledgerlens.llm.registry import register

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TERMS = (
    r"regexp_extract_all(translate(coalesce({0}, ''), '" + UPPER + "', '" + UPPER.lower() + r"'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
SQL = f"""
WITH d AS (SELECT doc_id, {TERMS.format("text")} AS t FROM documents),
size AS (SELECT doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
asked AS (SELECT item_id, unnest({TERMS.format("text")}) AS term FROM benchmark),
q AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM asked GROUP BY ALL),
held AS (SELECT doc_id, unnest(t) AS term FROM d),
tf AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM held SEMI JOIN q USING (term) GROUP BY ALL),
df AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, total),
part AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms)))) AS gain
  FROM tf JOIN w USING (term) JOIN size USING (doc_id), total),
s AS (SELECT item_id, doc_id, CAST(sum(times * gain) AS BIGINT) AS score FROM q JOIN part USING (term) GROUP BY ALL),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""


@register("op12_ranked_search", SQL)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
