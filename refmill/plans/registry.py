"""All queries of the core, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from refmill.plans import packed_queries, reference_queries

_MODULES = (packed_queries, reference_queries)
FLAGSHIP = "audit"
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
