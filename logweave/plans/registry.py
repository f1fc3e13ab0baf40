"""All queries of the core, by name."""

from __future__ import annotations

from logweave.plans import call_queries, core_problems, session_queries, state_queries, transcript_queries, usage_queries

_MODULES = (core_problems, call_queries, usage_queries, session_queries, transcript_queries, state_queries)


def queries() -> dict:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
