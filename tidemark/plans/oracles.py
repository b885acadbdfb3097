"""The SQL of the registered queries."""

from __future__ import annotations

from . import registry


def oracle_sql() -> dict[str, str]:
    return registry.sql()
