"""Registered queries, grouped by subject."""

from __future__ import annotations

import importlib
import pkgutil


def _registries():
    for info in sorted(pkgutil.iter_modules(__path__), key=lambda i: i.name):
        module = importlib.import_module(f"{__name__}.{info.name}")
        registry = getattr(module, "REGISTRY", None)
        if registry is not None:
            yield registry


def all_queries() -> dict:
    out: dict = {}
    for registry in _registries():
        clash = out.keys() & registry.queries.keys()
        if clash:
            raise KeyError(f"registered twice: {sorted(clash)}")
        out.update(registry.queries)
    return out


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for registry in _registries():
        out.update(registry.sql)
    return out
