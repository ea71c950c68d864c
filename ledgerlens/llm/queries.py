"""Import every query module of the subpackage; the registry then holds all of them."""

from __future__ import annotations

from ledgerlens.llm import (  # noqa: F401
    q_blocks,
    q_chat,
    q_decontamination,
    q_fingerprints,
    q_lines,
    q_near,
    q_pieces,
    q_quality,
    q_ranked,
    q_repeats,
    q_runs,
    q_search,
    q_toxicity,
)
from ledgerlens.llm.registry import ORACLES, QUERIES  # noqa: F401
