"""Registered queries of the library itself (the llm subpackage keeps its own registry)."""

from __future__ import annotations

from .queries import business, parsing, retrieval, sequences, streams, tables

FLAGSHIP = "hybrid_three_lane"

QUERIES: dict = {}
ORACLES: dict = {}
for module in (retrieval, tables, sequences, business, parsing, streams):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
