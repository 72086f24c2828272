"""Registered queries and their oracles, by operator."""

from __future__ import annotations

from corpusloom.queries import graph, ingest, languages, more, narration, tours

MODULES = (ingest, graph, narration, more, tours, languages)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
flagship = ingest.f1_reason_hist
