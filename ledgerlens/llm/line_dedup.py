"""Line dedup with DataFrame functions only.

Lines are exploded, normalised and hashed; documents are counted per hash; lines whose hash is in too
many documents go, except in the document with the largest id; what stays is put together by position.

The count is taken over (hash, document) pairs combined on the map side, so a line that stands in a
third of all documents is one partial row per task. The list of repeated lines is written as a table;
the join back to the lines has an exchange on either side, which lets AQE split a hot line. Only
(document, position) pairs are shuffled for it; each text is shuffled once, for putting it together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import checkpointed

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line that is long enough: document, hash of its text, position, hash of the key."""
    exploded = docs.select("_id", "_sign", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
    keyed = exploded.select("_id", "_sign", "_pos", line_key(F.col("_line")).alias("_key"))
    long_enough = keyed.where(F.length("_key") >= min_chars)
    return long_enough.select("_id", "_sign", "_pos", F.unhex(F.md5("_key")).alias("_hash"))


def _without(lines: Column, dropped: Column) -> Column:
    """``lines`` without the 0-based positions in ``dropped`` (ascending): the slices between them."""
    cuts = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))
    between = F.transform(
        F.sequence(F.lit(1), F.size(cuts) - 1),
        lambda i: F.slice(
            lines,
            F.get(cuts, i - 1) + 2,
            F.get(cuts, i) - F.get(cuts, i - 1) - 1,
        ),
    )
    return F.flatten(between)


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    min_chars: int = 40,
    min_docs: int = 5,
) -> DataFrame:
    """``docs`` with ``text_col`` deduplicated, plus ``n_lines`` (before) and ``n_dropped``.

    A line whose key has ``min_chars`` code points or more and is in ``min_docs`` documents or more
    stays only in the document with the largest id holding it. All other columns pass through; columns
    named ``n_lines`` or ``n_dropped`` are replaced.

    Null or empty text is one empty line. A null id counts for no line and loses every repeated line.
    Rows that share an id are one document for the count, and each is rebuilt on its own. Repeats inside
    one document count once; the document with the largest id keeps all of them. An empty table gives
    an empty table.
    """
    source = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_sign"),
    )
    lines = _lines(source, min_chars)
    repeated = checkpointed(
        lines.groupBy("_hash")
        .agg(F.count_distinct("_id").alias("_docs"), F.max("_id").alias("_last"))
        .where(F.col("_docs") >= min_docs)
        .select(F.col("_hash").alias("_repeated"), "_last")
    )
    lost = (
        lines.join(repeated, F.col("_hash") == F.col("_repeated"))
        .where(~F.col("_id").eqNullSafe(F.col("_last")))
        .groupBy(F.col("_id").alias("_lost_id"), F.col("_sign").alias("_lost_sign"))
        .agg(F.sort_array(F.collect_set("_pos")).alias("_lost"))
    )
    own = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    # The own columns travel in a struct, where their names meet none of those used here.
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_own"),
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_sign"),
    )
    match = F.col("_id").eqNullSafe(F.col("_lost_id")) & (F.col("_sign") == F.col("_lost_sign"))
    split = F.split(F.col("_text"), "\n")
    joined = marked.join(lost, match, "left")
    kept = F.when(F.col("_lost").isNull(), F.col("_text")).otherwise(
        F.array_join(_without(split, F.col("_lost")), "\n")
    )
    out = {
        text_col: kept.alias(text_col),
        "n_lines": F.size(split).cast("bigint").alias("n_lines"),
        "n_dropped": F.coalesce(F.size("_lost"), F.lit(0)).cast("bigint").alias("n_dropped"),
    }
    order = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*[out.get(c, F.col("_own")[c].alias(c)) for c in order], out["n_lines"], out["n_dropped"])
