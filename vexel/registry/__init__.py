"""The registered queries of the engine and their SQL."""

from __future__ import annotations

import importlib

_MODULES = ("vector_queries", "filter_queries", "index_queries", "live_queries", "calibration_queries", "collection_queries")


def registry() -> dict:
    """name -> (query, SQL or None)."""
    out = {}
    for m in _MODULES:
        out |= importlib.import_module(f"{__name__}.{m}").QUERIES
    return out
