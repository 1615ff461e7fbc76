"""Queries of the training-text operations (p2, p5, p8, p9, p10)."""

from __future__ import annotations

from quaymark.llm import fills, latency, leakage, mixing, reading

MODULES = (fills, latency, leakage, mixing, reading)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.oracle_sql().items()}
