"""All queries of the core by name, and the SQL that states the same result."""

from __future__ import annotations

from finspark.plans import arithmetic, events, facts, pages, reconcile, retrieval, scoring, spans, splits, textrules

MODULES = (facts, reconcile, arithmetic, spans, scoring, retrieval, splits, textrules, pages, events)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
