"""Whole jobs: the event plan, the chain runner and the registered queries."""

from __future__ import annotations

import importlib

QUERY_MODULES = (
    "catalog_queries",
    "damage_queries",
    "detail_queries",
    "media_queries",
    "plan_queries",
    "series_queries",
    "streaming_queries",
)


def load_queries():
    """Import every module that registers queries; returns (queries, oracles)."""
    for m in QUERY_MODULES:
        importlib.import_module(f"cuelattice.plans.{m}")
    from cuelattice.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
