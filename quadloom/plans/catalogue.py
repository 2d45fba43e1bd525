"""All queries of the core with their SQL oracles."""

from __future__ import annotations

from quadloom.plans import problems, sparql_queries, spatial_queries, store_queries

_MODULES = (problems, sparql_queries, store_queries, spatial_queries)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
