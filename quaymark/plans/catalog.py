"""All queries outside the training-text subpackage, with their SQL counterparts."""

from __future__ import annotations

from quaymark.plans import core_problems, domain, model_queries, operations, star, streams, surfaces

MODULES = (star, domain, operations, surfaces, model_queries, streams, core_problems)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.oracle_sql().items()}
