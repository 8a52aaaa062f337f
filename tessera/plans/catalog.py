"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from tessera.plans import evidence_queries, matrix_queries, more_queries, records, routing_queries, text_queries

_MODULES = [records, matrix_queries, evidence_queries, text_queries, routing_queries, more_queries]
FLAGSHIP = "qc_mad_outliers"
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
