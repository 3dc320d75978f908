"""Registry of the engine's own queries: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from tracemill.plans import dashboard, traces

MODULES = (dashboard, traces)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
