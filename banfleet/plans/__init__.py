"""Registered queries over the given tables, each with its SQL twin."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("reports", "feeds", "deliveries", "status", "inventory", "streams")


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in _MODULES:
        for key, value in getattr(import_module(f"{__name__}.{name}"), attribute).items():
            if key in found:
                raise ValueError(f"query {key} is registered twice")
            found[key] = value
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict[str, str]:
    return _collect("ORACLES")
