"""All runnable queries by key, with the statements that check them."""

from __future__ import annotations

from importlib import import_module

from skyledger.catalog import core

_GROUPS = ["reporting", "tables", "places", "signals", "streams"]


def _load() -> None:
    for group in _GROUPS:
        import_module(f"skyledger.catalog.{group}")


def queries():
    _load()
    return dict(core.QUERIES)


def oracle_sql():
    _load()
    return dict(core.ORACLES)
