"""Named queries over the driver tables, each with an equivalent SQL text where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL that must give the same rows."""
    def register(fn: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} registered twice")
        PLANS[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register
