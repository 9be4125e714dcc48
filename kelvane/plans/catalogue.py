"""All queries of the core engine."""

from __future__ import annotations

from .base import ORACLE, QUERIES


def _load() -> None:
    from . import multimodel, relational, surface, writes  # noqa: F401  registers


def queries() -> dict:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLE
