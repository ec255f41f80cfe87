"""Operators for preparing training data. Nothing else in the library imports this package."""

from __future__ import annotations

from importlib import import_module, util

MODULES = ("fusion", "quotas", "near_copies", "personal", "themes", "ledger", "encoding", "mixing", "garbled")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        if util.find_spec(f"{__name__}.{name}"):
            out.update(getattr(import_module(f"{__name__}.{name}"), attribute))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
