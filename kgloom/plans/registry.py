"""All queries of the library over the driver's tables, with their SQL."""

from __future__ import annotations

from kgloom.plans import graph_queries, rule_queries, text_queries

_MODULES = (graph_queries, rule_queries, text_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
FLAGSHIP = "kg_type_distribution"
