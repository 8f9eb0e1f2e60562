"""Registered queries over the driver's tables."""

from __future__ import annotations

import importlib

MODULES = ["q_sources", "q_gates", "q_joins", "q_observe", "q_aggregates", "q_sequences", "q_board",
           "q_curation", "q_geometry", "q_vectors", "q_streaming"]


def all_queries():
    """(queries, oracle SQL) of every module."""
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    from .registry import ORACLES, QUERIES, with_ctes

    return dict(QUERIES), {name: with_ctes(sql) for name, sql in ORACLES.items()}
