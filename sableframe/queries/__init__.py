"""Queries of the library over the common tables, with the same in SQL."""

from __future__ import annotations

from . import catalog, layout, operational, tabular, text, vision

_MODULES = (tabular, text, operational, vision, catalog, layout)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
