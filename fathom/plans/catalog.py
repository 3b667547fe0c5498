"""Every query of the engine by name, with its SQL."""

from __future__ import annotations

from fathom.plans import causal, clusters, curation, fusion, graphs, retrieval, staged, structures, temporal, texts, words

_PARTS = (retrieval, fusion, temporal, causal, graphs, clusters, curation, texts, words, structures, staged)
QUERIES = {name: f for part in _PARTS for name, f in part.query.queries.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.query.sql.items()}
