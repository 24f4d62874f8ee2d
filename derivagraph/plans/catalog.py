"""All queries of the core, with their oracles."""

from __future__ import annotations

from . import graph_problems, reference_queries

_MODULES = (graph_problems, reference_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}


def flagship(spark, d):
    """Words with the most derived words."""
    return reference_queries.e6_top_roots(spark, d)
