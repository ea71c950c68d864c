"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all
others as named users. The mask covers what the assistant writes: its content and the end marker.

A conversation is rendered in parts, one per range of ``PART_TURNS`` turn numbers, so that a task holds a part
and not a conversation; the rendering of a conversation is that of its parts, by ``part``. Participants are
found by a distinct over (conversation, role) and joined to the parts, not collected with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TURNS = 256
BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def _safe(text: Column) -> Column:
    """Text that cannot be taken for a marker."""
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def rotate(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    *,
    fixed_roles: Sequence[str] = ("system",),
) -> DataFrame:
    """(``conv_id``, ``perspective``, ``part``, ``n_turns``, ``rendered``, ``mask``): one row per part.

    Roles in ``fixed_roles`` are no speakers: they keep their role from every perspective and have none of
    their own. ``mask`` is an array of (start, stop) character positions in ``rendered``, ascending. Turns are
    in the order of ``turn``, then role, then text; ``part`` is floor(turn / PART_TURNS).

    Rows without a conversation id are left out. A null role is a speaker named ``unknown``, a null text is
    empty, a null turn comes first, in part null. Repeated rows are turns of their own. ``<|`` in a text or
    role becomes ``<\\|``. A conversation without speakers gives no row; an empty table an empty table.
    """
    role = F.coalesce(F.col(role_col), F.lit("unknown"))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv"),
        F.floor(F.col(turn_col) / PART_TURNS).alias("part"),
        F.struct(
            F.col(turn_col).alias("turn"), role.alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
        ).alias("t"),
    )
    speakers = (
        rows.select(F.col("conv").alias("_conv"), F.col("t.role").alias("perspective"))
        .where(~F.col("perspective").isin(list(fixed_roles)))
        .distinct()
    )
    parts = rows.groupBy("conv", "part").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    seen = parts.join(speakers, F.col("conv") == F.col("_conv"))

    def render(t: Column) -> Column:
        own = t["role"] == F.col("perspective")
        name = (
            F.when(own, F.lit("assistant"))
            .when(t["role"].isin(list(fixed_roles)), t["role"])
            .otherwise(F.concat(F.lit("user name="), _safe(t["role"])))
        )
        head = F.concat(F.lit(BEGIN), name, F.lit("\n"))
        body = F.concat(_safe(t["text"]), F.lit(END))
        return F.struct(F.concat(head, body).alias("all"), F.length(head).alias("head"), F.length(body).alias("body"), own.alias("own"))

    pieces = seen.withColumn("pieces", F.transform("turns", render))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("mask"))

    def add(state: Column, piece: Column) -> Column:
        first = state["at"] + piece["head"]
        after = first + piece["body"]
        span = F.struct(first.alias("start"), after.alias("stop"))
        mask = F.when(piece["own"], F.concat(state["mask"], F.array(span))).otherwise(state["mask"])
        return F.struct(after.alias("at"), mask.alias("mask"))

    return pieces.select(
        F.col("conv").alias(conv_col),
        "perspective",
        "part",
        F.size("turns").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: p["all"]), "").alias("rendered"),
        F.aggregate("pieces", start, add, lambda s: s["mask"]).alias("mask"),
    )
