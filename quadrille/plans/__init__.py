"""Registered queries over the operators."""

from __future__ import annotations

import importlib

from quadrille.plans import registry

_MODULES = ("detection", "text", "matching", "extraction", "reports", "maintenance", "streams")


def queries() -> dict[str, registry.Query]:
    for m in _MODULES:
        importlib.import_module(f"quadrille.plans.{m}")
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(registry.SQL)
