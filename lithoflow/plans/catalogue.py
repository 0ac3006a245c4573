"""Every query of the engine with its DuckDB oracle."""

from __future__ import annotations

from . import canonical, checks, explorer, lifecycle, matching, pages

MODULES = [matching, checks, canonical, pages, lifecycle, explorer]


def _all() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def queries() -> dict:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s}
