"""The registered queries, by topic, with their SQL."""

from __future__ import annotations

from verdict.plans import audit_queries, clause_queries, decision_queries, evidence_queries, graph_queries, guidance_queries, money_queries, reading_queries, subtotal_queries, temporal_queries, terms_queries, text_queries, unit_queries

_MODULES = (decision_queries, money_queries, temporal_queries, text_queries, graph_queries, audit_queries, evidence_queries, guidance_queries, reading_queries, terms_queries, clause_queries, unit_queries, subtotal_queries)


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.SQL.items()}
