"""The registered queries on the driver's tables and their SQL."""

from __future__ import annotations

from tracemill.plans import evaluation, fixtures, governance_queries, profiles, registry, sweeps, traces, verification


def queries() -> dict:
    assert evaluation and fixtures and governance_queries and profiles and sweeps and traces and verification
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)


def flagship(spark, sf_dir):
    """For each assistant turn: its group's split, the role before it, and the history that fits its budget."""
    return traces.turn_overview(spark, sf_dir)
